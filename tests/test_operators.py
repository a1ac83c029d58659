"""Order-dependent operators against plain loops, and the edge cases of the others."""

import random
import time

from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import chunking as C
from leafmill.operators import entities as E
from leafmill.operators import images as I
from leafmill.operators import layout as L
from leafmill.operators import markdown as M
from leafmill.operators import records as R
from leafmill.operators import retrieval as T


def greedy(units, limit):
    parts, cur = [], ""
    for unit in units:
        if cur and len(cur) + len(unit) + 2 > limit:
            parts.append(cur)
            cur = ""
        cur = f"{cur}\n\n{unit}" if cur else unit
    return parts + [cur] if cur else parts


def test_packing_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, ["x" * rng.randrange(1, 90) for _ in range(rng.randrange(0, 30))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, units array<string>").select("id", C.pack(F.col("units"), 100).alias("p"))
    assert {r["id"]: r["p"] for r in df.collect()} == {i: greedy(u, 100) for i, u in rows}


def test_tables_split_between_rows(spark):
    rows = [f"| Drug{i} | {i * 10}mg | {i}x daily |" for i in range(40)]
    df = spark.createDataFrame([(rows,)], "rows array<string>").select(C.split_table(F.lit("| Drug | Dose | Frequency |"), F.lit("|---|---|---|"), F.col("rows"), 300).alias("p"))
    parts = df.first()["p"]
    assert len(parts) > 1 and all(len(p) <= 300 and p.startswith("| Drug | Dose | Frequency |\n|---|---|---|\n") for p in parts)
    assert [line for p in parts for line in p.split("\n")[2:]] == rows


def test_short_pages_stay_and_paragraphs_keep_their_order(spark):
    long = "\n\n".join(f"paragraph {i} " + "y" * 80 for i in range(60))
    df = spark.createDataFrame([(1, "one short line"), (2, long), (3, "tiny")], "id int, text string")
    got = {}
    for r in C.chunks(df, ["id"]).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got[1] == ["one short line"] and 3 not in got
    assert all(len(t) <= 2000 for t in got[2]) and "\n\n".join(got[2]) == long


def merged(boxes):
    """Each box not yet taken goes once over the later ones and grows."""
    out, taken = [], set()
    for i, box in enumerate(boxes):
        if i in taken:
            continue
        head = list(box)
        for j in range(i + 1, len(boxes)):
            b = boxes[j]
            w, h = min(head[4], b[4]) - max(head[2], b[2]), min(head[5], b[5]) - max(head[3], b[3])
            small = min((x[4] - x[2]) * (x[5] - x[3]) for x in (head, b))
            if j not in taken and w > 0 and h > 0 and small > 0 and w * h / small > 0.3:
                taken.add(j)
                head[1] = b[1] if head[1] == "Paragraph" else head[1]
                head[2:] = [min(head[2], b[2]), min(head[3], b[3]), max(head[4], b[4]), max(head[5], b[5])]
        out.append(tuple(head))
    return out


def test_a_box_passed_over_stays(spark):
    rows = [(1, 1, "Table", 0, 0, 100, 10), (1, 2, "Table", 110, 0, 150, 10), (1, 3, "Table", 40, 0, 160, 10)]
    df = spark.createDataFrame(rows, "page int, region int, kind string, x1 long, y1 long, x2 long, y2 long")
    assert sorted((r["x1"], r["x2"]) for r in L.merge_boxes(df).collect()) == [(0, 160), (110, 150)]


def test_merged_boxes_do_not_overlap(spark):
    rng = random.Random(2)
    rows = []
    for page in range(5):
        for region in range(12):
            x, y = rng.randrange(800), rng.randrange(800)
            rows.append((page, region, rng.choice(["Paragraph", "Table"]), x, y, x + rng.randrange(50, 300), y + rng.randrange(50, 300)))
    df = spark.createDataFrame(rows, "page int, region int, kind string, x1 long, y1 long, x2 long, y2 long")
    out = L.merge_boxes(df)
    assert L.overlap_pairs(out).count() <= L.overlap_pairs(df).count()
    for page in range(5):
        mine = [r for r in out.collect() if r["page"] == page]
        assert (min(r["x1"] for r in mine), max(r["y2"] for r in mine)) == (min(r[3] for r in rows if r[0] == page), max(r[6] for r in rows if r[0] == page))
        assert sorted(tuple(r)[1:] for r in mine) == sorted(merged([r[1:] for r in rows if r[0] == page]))


def test_no_cartesian_product(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 5, 5)], "page int, region int, x1 int, y1 int, x2 int, y2 int")
    names = spark.createDataFrame([(1, "abcd")], "id int, token string")
    codes = spark.createDataFrame([("abc",)], "code string")
    for df in (L.overlap_pairs(boxes), L.region_bands(boxes, L.bands(boxes, 10, 10)), E.containment(names, codes)):
        assert "CartesianProduct" not in df._jdf.queryExecution().toString()


def test_markdown_edges(spark):
    text = "**Referred Doctor:** Dr. Smith\n| a | b |\n|---|---|\n| 1 |\n\nplain | bar\nend"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    cells = {(r["row_no"], r["header"]): r["value"] for r in M.table_cells(df, "id").collect()}
    assert cells == {(1, "a"): "1", (1, "b"): ""}
    assert [tuple(r) for r in M.key_values(df, "id").collect()] == [(1, "Referred Doctor", "Dr. Smith")]


def test_text_functions(spark):
    row = spark.createDataFrame([("x",)], "x string").select(
        X.clean_output(F.lit("a<|text|>hello</|text|>b")).alias("a"),
        X.json_payload(F.lit('Sure\n```json\n{"test": 123}\n```')).alias("b"),
        X.compact_code(F.lit("ITEM – 6297")).alias("c"),
        X.entity_candidate(F.lit("12/03/2024"), F.lit(False)).alias("d"),
        X.entity_candidate(F.lit("Q4H"), F.lit(False)).alias("e"),
        X.clean_output(F.lit("<think>only</think>")).alias("f"),
    )
    assert tuple(row.first()) == ("hello", '{"test": 123}', "item6297", False, True, "<think>only</think>")


def test_relevance_gate_keeps_or_empties(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.001), (2, 0.01)], "query_id int, s double")
    assert sorted(r["s"] for r in T.relevance_gate(df, "s").collect()) == [0.001, 0.5]
    assert [r["s"] for r in T.relevance_gate(df, "s", per_row=True).collect()] == [0.5]


def test_kinds_that_change(spark):
    rows = [(1, 0, "list", None, ["a", "b", "a"], None), (1, 1, "scalar", "n/a", None, None), (2, 0, "scalar", "x", None, None), (2, 1, "map", None, None, {"k": "v"}),
            (3, 0, "map", None, None, {"k": "v"}), (3, 1, "scalar", "y", None, None), (3, 2, "list", None, ["z"], None)]
    df = spark.createDataFrame(rows, "id int, chunk int, kind string, scalar string, list array<string>, map map<string,string>")
    got = {(r["id"], r["kind"]): r["value"] for r in R.consolidate(df, ["id"]).collect()}
    assert got == {(1, "list"): '["a","b"]', (2, "map"): "v", (3, "scalar"): "y"}


def test_short_codes_are_contained(spark):
    tokens = spark.createDataFrame([(1, "take OD now"), (2, "b"), (3, "no-1 2x"), (4, "zz"), (5, ""), (6, "xabcdx")], "id long, token string")
    codes = spark.createDataFrame([("od",), ("BDS",), ("No 12",), ("abcd",)], "code string")
    assert {r["id"]: r["code"] for r in E.containment(tokens, codes).collect()} == {1: "od", 2: "abcd", 3: "No 12", 6: "abcd"}


def test_fuzzy_without_a_common_pair_of_letters(spark):
    tokens = spark.createDataFrame([(1, "abc"), (2, "mxnyozp"), (3, "q"), (4, "rs")], "id long, token string")
    codes = spark.createDataFrame([("ac",), ("mnop",), ("q",), ("tu",)], "code string")
    assert {r["id"]: r["code"] for r in E.fuzzy(tokens, codes).collect()} == {1: "ac", 2: "mnop", 3: "q"}


def test_corrections_are_plain_text(spark):
    docs = spark.createDataFrame([(1, "pay a\\Eb now, xa\\Eb not; cost two"), (2, "as is"), (3, "Éclair é")], "id int, text string")
    rows = [(1, 0, "a\\Eb", "c\\d$1", 0.95), (1, 1, "COST", "$5", 0.9), (1, 2, "now", "later", 0.87), (1, 3, "two", "three", 0.2), (1, 4, "", "x", 0.99), (3, 0, "éclair", "cake", 0.99)]
    got = E.apply_corrections(docs, spark.createDataFrame(rows, "id int, pos int, wrong string, right string, confidence double"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "pay c\\d$1 now, xa\\Eb not; $5 two", 2, 1), (2, "as is", 0, 0), (3, "cake é", 0, 0)]


def test_images_cost_grows_with_their_pixels(spark):
    rng = random.Random(4)
    px = [float(rng.randrange(100, 256)) for _ in range(200 * 200)]
    began = time.time()
    df = spark.createDataFrame([(1, px), (2, [200.0] * 400), (3, [200.0] * 399 + [0.0] * 101)], "id int, px array<double>")
    rows = {r["id"]: r for r in I.blank_pages(df).select("id", "ink", "is_blank", F.element_at(I.stretch(F.col("px")), 1).alias("first")).collect()}
    assert time.time() - began < 10
    s = sorted(px)
    at = lambda q: s[int(q)] + (s[min(int(q) + 1, len(s) - 1)] - s[int(q)]) * (q - int(q))
    low, high = at(0.02 * (len(s) - 1)), at(0.98 * (len(s) - 1))
    assert abs(rows[1]["first"] - max(0.0, min(255.0, (px[0] - low) * 255 / (high - low)))) < 1e-6
    assert abs(rows[1]["ink"] - sum(p < at(0.5 * (len(s) - 1)) - 30 for p in px) / len(px)) < 1e-6
    assert rows[2]["is_blank"] and not rows[3]["is_blank"]


def test_chunks_keep_tables_whole(spark):
    head = "| Drug | Dose | Frequency | Notes |\n|---|---|---|---|"
    row = lambda i: f"| Drug{i} | {i * 10}mg | {i}x daily | padding padding padding text {i} |"
    big = head + "\n" + "\n".join(map(row, range(40)))
    small = head + "\n" + "\n".join(map(row, range(5)))
    prose = "\n\n".join("p" * 700 + str(i) for i in range(3))
    texts = ["Just a short note.", "List follows.\n\n" + big + "\n\nEnd of report.", prose + "\n" + small + "\nmore | bars\n\ntail"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in C.chunks(df, ["id"]).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got[0] == texts[:1] and len(got[1]) > 1
    drugs = [line for t in got[1] for line in t.split("\n") if line.startswith("| Drug") and "Dose" not in line]
    assert drugs == list(map(row, range(40))) and all(head in t for t in got[1][:-1]) and got[1][-1].endswith("End of report.")
    assert any(small + "\nmore | bars" in t for t in got[2])


def test_entities_in_text(spark):
    rows = [(1, "PCM500", "ITEM", "Paracetamol tablet", None, None), (2, "OD", "FREQUENCY", None, "once a day", "morning"), (3, "SVC9", "SERVICE", "Ward visit", None, None)]
    catalog = spark.createDataFrame(rows, "cat_id long, code string, type string, name string, meaning string, timing string")
    text = "| S.No | Test |\n|---|---|\n| 1 | pcm500 |\n- OD\nplain words\nname: OD\nWARD VISTI\n1. SVC9 "
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    found, whole = E.resolve_entities(docs, catalog, "id")
    got = sorted((r["line_no"], r["cell_no"], r["text"], r["code"], r["name"]) for r in found.collect())
    assert got == [(2, 2, "pcm500", "PCM500", "Paracetamol tablet"), (3, 0, "OD", "OD", "once a day"), (6, 0, "WARD VISTI", "SVC9", "Ward visit"), (7, 0, "SVC9", "SVC9", "Ward visit")]
    lines = {r["id"]: r["text"] for r in whole.collect()}
    assert lines[2] == lines[3] == "" and lines[1].split("\n") == [
        "| S.No | Test |", "|---|---|", "| 1 | Paracetamol tablet [PCM500 → Paracetamol tablet] |", "- once a day [OD → once a day morning]", "plain words", "name: OD",
        "Ward visit [SVC9 → Ward visit]", "1. Ward visit  [SVC9 → Ward visit]",
    ]


def test_annotated_mentions_of_codes(spark):
    catalog = spark.createDataFrame([("OD", "once", "at 8"), ("B-D", "twice", None)], "code string, meaning string, instruction string")
    docs = spark.createDataFrame([(1, "od and bd, b d; BODY OD"), (2, "none"), (3, "")], "id int, text string")
    got = {r["id"]: r["text"] for r in E.annotate_codes(docs, catalog, "id", ["OD", "B-D", "XX"]).collect()}
    assert got == {1: "od [Freq → once; Instr → at 8] and bd [Freq → twice; Instr → ], b d [Freq → twice; Instr → ]; BODY OD [Freq → once; Instr → at 8]", 2: "none", 3: ""}
    assert E.code_mentions(docs, "id", []).count() == 0


def test_a_saved_index_is_the_fitted_one(spark, tmp_path):
    names = spark.createDataFrame([(1, "goldenrod lace"), (2, "plum dim"), (3, "lace plum")], "cat_id long, name string")
    vocabulary, index = E.tfidf_fit(names)
    E.save_index(vocabulary, index, str(tmp_path / "index"))
    tokens = spark.createDataFrame([(7, "goldenrad"), (8, "plumm dim"), (9, "zzz")], "id long, token string")
    want = sorted(map(tuple, E.tfidf_nearest(tokens, vocabulary, index).collect()))
    assert sorted(map(tuple, E.tfidf_nearest(tokens, *E.load_index(spark, str(tmp_path / "index"))).collect())) == want and len(want) == 2


def test_candidates_by_rule(spark):
    yes = ["PCM500", "OD", "5MGX", "A1", "known one"]
    no = ["a", "Name OD", "AGE:45", "DOB:1990", "12/10/2020 X", "10 PM", "10:30 A", "5 days", "500mg", "plain", "VERYLONGUPPERCASE", ""]
    df = spark.createDataFrame([(t, t == "known one") for t in yes + no], "t string, known boolean")
    assert {r["t"] for r in df.where(X.entity_candidate(F.col("t"), F.col("known"))).collect()} == set(yes)


def test_tables_are_read_from_their_document_alone(spark):
    rng = random.Random(3)
    pieces = ["| a | b |", "|---|", "---", "x", "", "a | b", "|", "| - |", "- | c", "|:-:|"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    rule = lambda s: "-" in s and set(s) <= set(" \t|:-")
    want = set()
    for i, t in enumerate(texts):
        lines = t.split("\n")
        start = n = None
        for p, line in enumerate(lines):
            if "|" not in line:
                start = None
                continue
            if start is None and not rule(line) and p + 1 < len(lines) and rule(lines[p + 1]):
                start, n = p, 0
            if start is not None and not rule(line):
                want.add((i, start, n, p, line))
                n += 1
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "id long, text string")
    rows = M.table_rows(docs, "id")
    assert {tuple(r)[:5] for r in rows.collect()} == want and len(want) > 100
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
