"""Joins by grams, characters and automata against all pairs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import compact_code
from leafmill.operators import entities as E
from leafmill.operators import patterns as P


def words(rng, n, low, high, letters="abcdeé1-"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def compact(spark, texts):
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string").select("t", compact_code(F.col("t")).alias("c")).collect()
    return {r["t"]: r["c"] for r in rows}


@pytest.mark.parametrize("least", [0.7, 0.5, 0.9])
def test_fuzzy_equals_all_pairs(spark, least):
    rng = random.Random(9)
    tokens, codes = words(rng, 60, 0, 12) + ["abcde"] * 2, words(rng, 50, 0, 14)
    forms = compact(spark, tokens + codes)
    want = {}
    for i, t in enumerate(tokens):
        found = [(round(difflib.SequenceMatcher(None, forms[t], forms[c]).ratio(), 6), c) for c in codes if forms[t] and forms[c]]
        found = [x for x in found if x[0] >= least]
        if found:
            want[i] = max(found)
    got = E.fuzzy(spark.createDataFrame(list(enumerate(tokens)), "id long, token string"), spark.createDataFrame([(c,) for c in codes], "code string"), least)
    assert {r["id"]: (r["ratio"], r["code"]) for r in got.collect()} == want


def test_fuzzy_match_of_all_parts_compares_few_pairs(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    asked = part.select(compact_code(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))).alias("t")).distinct()
    known = part.select(F.col("p_name").alias("code"), compact_code(F.col("p_name")).alias("c")).distinct()
    pairs = E.fuzzy_pairs(asked, known).mapInArrow(E._bounds, "t string, c string, code string, bound double").where("bound >= 0.7")
    product = asked.count() * known.count()
    assert pairs.count() < product / 3
    names, texts = [(r["code"], r["c"]) for r in known.collect()], [r["t"] for r in asked.collect()]
    reach = {(t, code) for t in texts for code, c in names if difflib.SequenceMatcher(None, t, c).ratio() >= 0.7}
    assert reach <= {(r["t"], r["code"]) for r in pairs.collect()}


def test_nothing_meets_nothing(spark):
    none, some = spark.createDataFrame([], "id long, token string"), spark.createDataFrame([(1, None), (2, "")], "id long, token string")
    codes = spark.createDataFrame([("a-1",), (None,), ("",)], "code string")
    for tokens in (none, some):
        assert E.fuzzy(tokens, codes).count() == E.containment(tokens, codes).count() == 0
        assert [r["code"] for r in E.resolve_chain(tokens, codes.where("code <> ''")).collect()] == [None] * tokens.count()
    assert E.fuzzy(spark.createDataFrame([(1, "a")], "id long, token string"), codes.limit(0)).count() == 0


def test_containment_equals_all_pairs(spark):
    rng = random.Random(2)
    tokens, codes = words(rng, 150, 0, 9, "abcdé1"), sorted(set(words(rng, 60, 1, 6, "abcdé1")))
    forms = compact(spark, tokens + codes)
    want = {}
    for i, t in enumerate(tokens):
        for x, of in ((t.lower(), str.lower), (forms[t], forms.get)):
            found = [c for c in codes if x and of(c) and (x in of(c) or of(c) in x)]
            if found:
                want[i] = min(found, key=lambda c: (-len(c), c))
                break
    got = E.containment(spark.createDataFrame(list(enumerate(tokens)), "id long, token string"), spark.createDataFrame([(c,) for c in codes], "code string"))
    assert {r["id"]: r["code"] for r in got.collect()} == want


def test_cosine_join_meets_by_rare_grams(spark):
    rng = random.Random(3)
    stems = words(rng, 30, 3, 5, "abcdefghijklmnopqrst")
    names = sorted({" ".join(rng.sample(stems, 3)) + " tablet coated" for _ in range(300)})
    tokens = [n.replace("a", "e", 1)[: rng.randrange(8, 40)] for n in names] + ["zzz", "", None, names[0], names[0]]
    catalog = spark.createDataFrame(list(enumerate(names)), "cat_id long, name string")
    vocabulary, index = (x.cache() for x in E.tfidf_fit(catalog))
    asked = spark.createDataFrame(list(enumerate(tokens)), "id long, token string")
    vectors = E.token_vectors(asked.select("token").distinct(), vocabulary).cache()
    every = vectors.join(index.withColumnRenamed("weight", "v"), "gram")
    scores = every.groupBy("token", "cat_id").agg(F.round(F.sum(F.col("weight") * F.col("v")), 6).alias("s")).where("s > 0.55").collect()
    best = {}
    for r in scores:
        best[r["token"]] = min(best.get(r["token"], (0, 0)), (-r["s"], r["cat_id"]))
    want = {(i, best[t][1], -best[t][0]) for i, t in enumerate(tokens) if t in best}
    assert {tuple(r) for r in E.tfidf_nearest(asked, vocabulary, index).collect()} == want
    left, right = (E._rare_grams(v, vocabulary.select("gram", "df"), k, E.ACCEPT) for v, k in ((vectors, "token"), (index, "cat_id")))
    assert left.select("token", "gram").join(right.select("cat_id", "gram"), "gram").count() * 10 < every.count()


def regex(codes):
    """One alternation, longest first: what the automaton stands for."""

    def flexible(code):
        return "".join({" ": r"[\s-]+", "-": r"[\s-]*"}.get(p) or re.escape(p) for p in re.split(r"( |-)", code) if p)

    return re.compile(rf"(?<![A-Za-z0-9])({'|'.join(map(flexible, sorted(codes, key=lambda c: (-len(c), c))))})(?![A-Za-z0-9])", re.I | re.A)


def test_mentions_equal_one_alternation(spark):
    rng = random.Random(7)
    parts = ["od", "bd", "q", "8h", "1", "0", "äh", "x.y", "tab"]
    codes = {rng.choice(["", " ", "-", " - "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60)}
    joins = [" ", "-", "  ", " - ", "", "\n", ", ", "(", "\t-"]
    texts = ["".join(rng.choice([*parts, "word", "OD", "Q8H"]) + rng.choice(joins) for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, "", "- -", "od"]
    pattern = regex(codes)
    want = sorted((i, k, m.start(1), m.end(1), m.group(1)) for i, t in enumerate(texts) for k, m in enumerate(pattern.finditer(t or "")))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    catalog = spark.createDataFrame([(c,) for c in [*codes, None, "", "--"]], "code string")
    got = [tuple(r) for r in P.mentions(docs, "id", catalog).collect()]
    assert sorted(r[:5] for r in got) == want
    assert sorted(got) == sorted(tuple(r) for r in P.mentions(docs, "id", catalog, most=1_000).collect())  # several blocks
    assert P.mentions(docs, "id", catalog.limit(0)).count() == 0


def test_a_hundred_thousand_codes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat(F.lit("take code-777 77 or "), "text", F.lit(" code 99999")).alias("text"))
    codes = spark.range(100_000).select(F.concat(F.lit("code-"), "id").alias("code"))
    found = P.mentions(docs, "doc_id", codes).groupBy("code").count().collect()
    assert {r["code"]: r["count"] for r in found} == {"code-777": docs.count(), "code-99999": docs.count()}


def test_chain_asks_each_tier_for_what_is_open(spark):
    catalog = spark.createDataFrame([("OD",), ("B-D",), ("after meals",), ("twice daily",)], "code string")
    tokens = ["od", "bd", "x after meals y", "guess", "twise dayly", "nothing at all", None, "od"]
    asked = []

    def classify(df):
        asked.extend(r["token"] for r in df.collect())
        return df.select("id", F.when(F.col("token") == "guess", "OD").when(F.col("token") == "twise dayly", "unknown").alias("code"))

    rows = E.resolve_chain(spark.createDataFrame(list(enumerate(tokens)), "id long, token string"), catalog, classify).collect()
    got = {r["id"]: (r["code"], r["tier"]) for r in rows}
    assert got == {0: ("OD", "exact"), 1: ("B-D", "compact"), 2: ("after meals", "containment"), 3: ("OD", "classifier"), 4: ("twice daily", "fuzzy"), 5: (None, None), 6: (None, None), 7: ("OD", "exact")}
    assert "od" not in asked and "guess" in asked


def test_equal_tokens_are_contained_once(spark, monkeypatch):
    asked, plain = [], E._contained
    monkeypatch.setattr(E, "_contained", lambda tokens, known: asked.append(tokens.count()) or plain(tokens, known))
    tokens = spark.createDataFrame([(i, ["xx alpha yy", "alph", "zzz", None][i % 4]) for i in range(80)], "id long, token string")
    got = E.containment(tokens, spark.createDataFrame([("Alpha",), ("Beta",)], "code string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, "Alpha") for i in range(80) if i % 4 < 2] and asked == [3, 3]


def test_equal_names_are_one_entry_that_weighs_as_many(spark, monkeypatch):
    fitted, plain = [], E.tfidf_fit
    monkeypatch.setattr(E, "tfidf_fit", lambda names: fitted.append(names) or plain(names))
    names = ["red ring", "red ring", "blue bolt", "red ring", "old plate"]
    rows = [(i, f"ITEM{i}", "ITEM", n, None, None) for i, n in enumerate(names)]
    catalog = spark.createDataFrame(rows, "cat_id long, code string, type string, name string, meaning string, timing string")
    docs = spark.createDataFrame([(1, "- red ring 5x\n- blue bolt 5x")], "id long, text string")
    got = {r["text"]: (r["code"], r["confidence"]) for r in E.resolve_entities(docs, catalog, "id")[0].collect()}
    every = catalog.select("cat_id", "name")
    tokens = spark.createDataFrame([("red ring 5x", "red ring 5x"), ("blue bolt 5x", "blue bolt 5x")], "id string, token string")
    want = {r["id"]: (f"ITEM{r['cat_id']}", f"{r['score']:.2f}") for r in E.tfidf_nearest(tokens, *plain(every)).collect()}
    assert got == want and len(got) == 2 and fitted[0].count() == 3


def test_texts_read_as_one_keep_their_mentions_apart():
    texts = ["x Q1H", "Q2 H", None, "", "aQ1H", "Q1", "H q2-h", "q1h\0Q1H", "Q1Hb Q1H"]
    codes = P.Codes(["Q1H", "Q2 H", "H\0Q1", "Q1\0H"])
    apart = [codes.matches([t])[0] for t in texts]
    assert codes.matches(texts) == apart
    assert apart == [[(2, 5, -3, "Q1H")], [(0, 4, -4, "Q2 H")], [], [], [], [], [(2, 6, -4, "Q2 H")], [(0, 3, -3, "Q1H"), (4, 7, -3, "Q1H")], [(5, 8, -3, "Q1H")]]


def test_bands_meet_boxes_in_parts_of_bounded_size(spark):
    from leafmill.operators import layout as L
    from leafmill.operators.sized import dealt

    rows = [(p, r, 0, 10 * r, 700 if r % 3 == 0 else 100, 10 * r + 5 + p % 4) for p in range(400) for r in range(5)]
    boxes = dealt(spark.createDataFrame(rows, "page long, region int, x1 long, y1 long, x2 long, y2 long"), "page", rows=100)
    assert boxes.rdd.getNumPartitions() == 20
    found = L.region_bands(boxes, L.bands(boxes, 1000, 1000))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # each side is dealt, nothing else moves
    got = {(r["page"], r["region"]): r["band"] for r in found.collect()}

    def band(page, y1, y2):
        edges = sorted({0, 1000} | {y for p, _, _, a, x, b in rows if p == page and x >= 600 for y in (a, b)})
        return next((k for k in range(len(edges) - 1) if edges[k] <= (y1 + y2) / 2 <= edges[k + 1]), 0)

    assert got == {(p, r): band(p, y1, y2) for p, r, _, y1, _, y2 in rows}


def test_grams_and_fields_are_counted_where_their_key_is(spark):
    from leafmill.operators import models as M
    from leafmill.operators import records as R
    from leafmill.operators.sized import dealt

    names = spark.createDataFrame([(k, f"name {k % 50}") for k in range(500)] + [(500, ""), (501, None), (502, "ab")], "id long, name string")
    v = M.hashed_embedding(names, "id", "name")
    assert v._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert v.count() == 500
    said = dealt(spark.createDataFrame([(k, n, "x" if k % 2 else " ") for k in range(300) for n in ("a", "b", "other", "a")] + [(300, "none", "x"), (301, None, "x")], "id long, name string, value string"), "id", rows=100)
    fields = spark.createDataFrame([("a", "text", None), ("b", "text", None), ("c", "text", None)], "name string, type string, items array<string>")
    done = R.completeness(said, fields, "id")
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in done.collect()} == {(k, 4, 3 * (k % 2), 4 - 3 * (k % 2)) for k in range(300)} | {(300, 3, 0, 3), (301, 3, 0, 3)}
