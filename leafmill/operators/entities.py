"""Entity resolution against code catalogs: exact, compact, containment, fuzzy and n-gram cosine tiers."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import annotation, compact_code, entity_candidate, normalize_code
from leafmill.operators.patterns import marked, mentions, with_mentions
from leafmill.operators.sized import is_small, shuffled
from leafmill.sources.shared import folder

ACCEPT = 0.55
FUZZY_LEAST = 0.7
#: Head cells of tables that are no entities.
TABLE_LABELS = ("s.no", "test code/name", "sample type", "patient name", "age/sex")
APPLY, SURE = 0.9, 0.85  # confidence of corrections


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the highest order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def resolve_codes(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """tokens (id, token) with code and tier: exact on the normalised token, else on the compact one."""
    exact = catalog.select(F.col("code").alias("exact_code"), normalize_code(F.col("code")).alias("norm")).groupBy("norm").agg(F.min("exact_code").alias("exact_code"))
    loose = catalog.select(F.col("code").alias("loose_code"), compact_code(F.col("code")).alias("compact")).groupBy("compact").agg(F.min("loose_code").alias("loose_code"))
    keyed = tokens.withColumn("norm", normalize_code(F.col("token"))).withColumn("compact", compact_code(F.col("token")))
    found = keyed.join(exact, "norm", "left").join(loose, "compact", "left")
    tier = F.when(F.col("exact_code").isNotNull(), "exact").when(F.col("loose_code").isNotNull(), "compact")
    return found.select("id", "token", F.coalesce("exact_code", "loose_code").alias("code"), tier.alias("tier"))


def grams(text: Column, low: int, high: int) -> Column:
    """All substrings of `low` to `high` characters, blanks collapsed and lower-cased."""
    t = F.lower(F.regexp_replace(text, r"\s\s+", " "))
    none = F.array().cast("array<string>")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    parts = [F.when(F.length(t) >= n, cut(n)).otherwise(none) for n in range(low, high + 1)]
    return F.concat(*parts)


def containment(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, code): the longest code that contains the token or is part of it, else the same by compact forms.

    Candidates share a 3-gram, or a 1- or 2-gram that is the whole code or token: equalities that Spark can hash.
    Codes first by length, then by name. Empty tokens and codes match nothing. Equal tokens are matched once.
    """
    texts = tokens.where("token IS NOT NULL").select("token").distinct().select(F.col("token").alias("id"), "token")
    plain = _contained(texts.select("id", F.lower("token").alias("t")), catalog.select("code", F.lower("code").alias("c")))
    compact = _contained(texts.select("id", compact_code(F.col("token")).alias("t")), catalog.select("code", compact_code(F.col("code")).alias("c")))
    pairs = plain.withColumn("tier", F.lit(0)).unionByName(compact.withColumn("tier", F.lit(1)))
    w = Window.partitionBy("id").orderBy("tier", F.length("code").desc(), "code")
    found = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("id").alias("token"), "code")
    return tokens.join(F.broadcast(found) if is_small(texts) else shuffled(found), "token").select("id", "code")


def _contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(id, code) of tokens (id, t) and codes (code, c) of which one contains the other; of the codes around a short token the first.

    All 3-grams of the longer text meet one of the shorter, the one that fewest of the longer have: once in each direction.
    """
    side = lambda df, low, high, text: df.select("*", F.explode(F.array_distinct(grams(F.col(text), low, high))).alias("g"))

    def within(inner: DataFrame, small: str, outer: DataFrame, big: str) -> DataFrame:
        all_grams = side(outer, 3, 3, big)
        often = all_grams.groupBy("g").agg(F.count("*").alias("df"))
        own = side(inner.where(F.length(small) >= 3), 3, 3, small).join(shuffled(often), "g", "left")  # a gram that no outer text has ends the search
        rare = own.groupBy(*inner.columns).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))["g"].alias("g"))
        return rare.join(shuffled(all_grams), "g").where(F.instr(F.col(big), F.col(small)) > 0).select("id", "code")

    short = known.where(F.length("c") < 3).groupBy("c").agg(F.min_by("code", F.struct(-F.length("code"), "code")).alias("code"))
    inside = side(asked, 1, 2, "t").join(short.withColumnRenamed("c", "g"), "g")
    around = side(known, 1, 2, "c").groupBy("g").agg(F.min_by("code", F.struct(-F.length("code"), "code")).alias("code"))
    outside = asked.where(F.length("t") < 3).join(around.withColumnRenamed("g", "t"), "t")
    met = within(known, "c", asked, "t").unionByName(within(asked, "t", known, "c")).distinct()
    return met.unionByName(inside.select("id", "code")).unionByName(outside.select("id", "code"))


def _histogram(text: str) -> Counter:
    """Characters and pairs of neighbours of a text."""
    return Counter(text) + Counter(zip(text, text[1:], strict=False))


def most_matched(a: str, b: str, parts: Counter, others: Counter) -> int:
    """The most characters that matching blocks of two texts can hold.

    Blocks match characters that both have, C at most. M characters in n blocks are M - n pairs of neighbours that both
    have, and n blocks have at least n - 1 characters between them: with G common pairs, M <= (G + len(a) + len(b) + 1) / 3.
    """
    common = parts & others
    pairs = sum(n for x, n in common.items() if isinstance(x, tuple))
    return min(sum(common.values()) - pairs, (pairs + len(a) + len(b) + 1) // 3)


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest ratio that each pair can have."""
    for batch in batches:
        t, c = batch.column("t").to_pylist(), batch.column("c").to_pylist()
        parts = {x: _histogram(x) for x in {*t, *c}}
        bounds = [2 * most_matched(x, y, parts[x], parts[y]) / (len(x) + len(y)) for x, y in zip(t, c, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.float64())], names=[*batch.schema.names, "bound"])


def _best_so_far(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ratios of pairs in the order of t and bound; a pair is compared while its bound reaches the best of its token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, best = None, least
        for batch in batches:
            kept, ratios = [], []
            for k, (t, c, bound) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("t", "c", "bound")), strict=True)):
                if t != token:
                    token, best = t, least
                if bound >= best - 1e-9:
                    ratio = difflib.SequenceMatcher(None, t, c).ratio()
                    if ratio >= least:
                        best = max(best, ratio)
                        kept.append(k)
                        ratios.append(ratio)
            yield pa.RecordBatch.from_arrays([*[batch.column(x).take(pa.array(kept, pa.int64())) for x in ("t", "code")], pa.array(ratios, pa.float64())], names=["t", "code", "ratio"])

    return run


def _rare_characters(texts: DataFrame, often: DataFrame, text: str, least: float) -> DataFrame:
    """texts with n of their rarest numbered characters (the second `e` is another than the first), as rows.

    Texts of ratio `least` have M >= least * (a + b) / 2 characters in common, and b >= a * least / (2 - least). So of
    len - M + 1 characters of each, the rarest in one order, one is common to both.
    """
    numbered = _numbered_characters(texts, text).join(often, "x")
    ranked = numbered.groupBy(text).agg(F.sort_array(F.collect_list(F.struct("df", "x")))["x"].alias("xs"))
    need = F.ceil(F.length(text) * (least / (2 - least)) - 1e-9)  # least * (a + a * least / (2 - least)) / 2
    return ranked.select(text, F.explode(F.slice("xs", F.lit(1), (F.length(text) - need + 1).cast("int"))).alias("x"))


def _numbered_characters(texts: DataFrame, text: str) -> DataFrame:
    chars = texts.select(text, F.explode(F.split(text, "")).alias("x")).where("x <> ''").groupBy(text, "x").agg(F.count("*").alias("n"))
    return chars.select(text, F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat(F.col("x"), i.cast("string")))).alias("x"))


def fuzzy_pairs(asked: DataFrame, known: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """(t, c, code): pairs of texts that may have the ratio; asked has (t), known (code, c), both distinct."""
    asked, known = asked.where("t <> ''"), known.where("c <> ''")
    often = _numbered_characters(known, "c").groupBy("x").agg(F.count("*").alias("df"))
    a, b = F.length("t"), F.length("c")
    met = _rare_characters(asked, often.unionByName(_absent(asked, often)), "t", least).join(_rare_characters(known.select("c").distinct(), often, "c", least), "x")
    met = met.where(2 * F.least(a, b) >= least * (a + b)).select("t", "c").distinct()
    return met.join(known, "c").select("t", "c", "code")


def _absent(asked: DataFrame, often: DataFrame) -> DataFrame:
    """Numbered characters that no code has: the rarest of all."""
    own = _numbered_characters(asked, "t").select("x").distinct().join(often, "x", "left_anti")
    return own.select("x", F.lit(0).cast("long").alias("df"))


def fuzzy(tokens: DataFrame, catalog: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """(id, code, ratio): the most similar code by matching blocks, if similar enough; of equal ones the last by name.

    Pairs meet by their rarest characters, then bounds of what they can have in common rule most of them out; of what
    is left a token's pairs are compared from the highest bound on, until no bound reaches the best ratio found. Equal
    tokens are compared once. `least` is above 0; empty tokens and codes match nothing.
    """
    asked = tokens.select("id", compact_code(F.col("token")).alias("t"))
    known = catalog.select("code", compact_code(F.col("code")).alias("c")).distinct()
    pairs = fuzzy_pairs(asked.select("t").distinct(), known, least)
    bounded = pairs.mapInArrow(_bounds, "t string, c string, code string, bound double").where(F.col("bound") >= least - 1e-9)
    ordered = bounded.repartition("t").sortWithinPartitions("t", F.desc("bound"))
    rated = ordered.mapInArrow(_best_so_far(least), "t string, code string, ratio double")
    best = rated.groupBy("t").agg(F.max_by(F.struct("code", "ratio"), F.struct(F.round("ratio", 6), F.col("code"))).alias("b"))
    return asked.join(best, "t").select("id", "b.code", F.round("b.ratio", 6).alias("ratio"))


def tfidf_fit(catalog: DataFrame, low: int = 2, high: int = 4) -> tuple[DataFrame, DataFrame]:
    """(gram, df, idf) and (cat_id, gram, weight): L2-normalised weights of catalog names (cat_id, name).

    A column n, if there is one, says how many entries have the name; they count in df and idf.
    """
    catalog = catalog.select("cat_id", "name", F.col("n") if "n" in catalog.columns else F.lit(1).cast("long").alias("n"))
    counts = catalog.select("cat_id", "n", F.explode(grams(F.col("name"), low, high)).alias("gram")).groupBy("cat_id", "gram").agg(F.count("*").alias("tf"), F.max("n").alias("times"))
    total = catalog.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # one row
    df = counts.groupBy("gram").agg(F.sum("times").alias("df")).crossJoin(F.broadcast(total))
    vocabulary = df.select("gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.drop("times").join(shuffled(vocabulary), "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("cat_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vocabulary, weighted.join(shuffled(norms), "cat_id").select("cat_id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def _rare_grams(weights: DataFrame, often: DataFrame, key: str, accept: float) -> DataFrame:
    """Of each vector the grams, rarest first, without which a cosine of `accept` can't be reached.

    weights has (key, gram, weight), of norm 1. The most frequent grams that together have a norm under `accept` are
    left out: what they add to any cosine stays under it. So two vectors as close as that have their rarest common gram
    among these on both sides.
    """
    ranked = weights.join(shuffled(often), "gram")
    mass = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key).orderBy(F.desc("df"), "gram"))
    return ranked.withColumn("mass", mass).where(F.col("mass") >= accept * accept - 1e-9).select(key, "gram", "weight")


def cosine_candidates(asked: DataFrame, index: DataFrame, vocabulary: DataFrame, accept: float) -> DataFrame:
    """(token, cat_id): pairs that may have a cosine of `accept`, from vectors of norm 1 (token or cat_id, gram, weight)."""
    often = vocabulary.select("gram", "df")
    left = _rare_grams(asked, often, "token", accept).select("token", "gram")
    right = _rare_grams(index, often, "cat_id", accept).select("cat_id", "gram")
    return left.join(shuffled(right), "gram").select("token", "cat_id").distinct()


def token_vectors(texts: DataFrame, vocabulary: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(token, gram, weight) of distinct tokens (token), of norm 1 over the grams that the vocabulary has."""
    counts = texts.select("token", F.explode(grams(F.col("token"), low, high)).alias("gram")).groupBy("token", "gram").agg(F.count("*").alias("tf"))
    weighted = counts.join(shuffled(vocabulary), "gram").select("token", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("token").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(shuffled(norms), "token").select("token", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_nearest(tokens: DataFrame, vocabulary: DataFrame, index: DataFrame, accept: float = ACCEPT, low: int = 2, high: int = 4) -> DataFrame:
    """(id, cat_id, score): the nearest catalog entry of each token (id, token) above `accept`; first wins ties.

    A thresholded join: pairs meet by their rare grams alone, frequent grams only add to the pairs found. Equal tokens
    are scored once.
    """
    texts = tokens.select("token").distinct()
    asked = token_vectors(texts, vocabulary, low, high)
    pairs = cosine_candidates(asked, index, vocabulary, accept)
    both = pairs.join(shuffled(asked), "token").join(shuffled(index.withColumnRenamed("weight", "v")), ["cat_id", "gram"])
    scored = both.groupBy("token", "cat_id").agg(F.round(F.sum(F.col("weight") * F.col("v")), 6).alias("score"))
    best = scored.groupBy("token").agg(F.min_by(F.struct("cat_id", "score"), F.struct(-F.col("score"), "cat_id")).alias("b"))
    near = best.select("token", "b.cat_id", "b.score").where(F.col("score") > accept)
    return tokens.join(F.broadcast(near) if is_small(texts) else shuffled(near), "token").select("id", "cat_id", "score")


def apply_corrections(docs: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """docs (key, text) after its corrections (key, pos, wrong, right, confidence), in order.

    A correction is applied from APPLY on where the word stands alone in any case; others are kept as
    suggestions, under SURE as uncertain ones (counts); empty and identical ones are skipped. Both sides are
    plain text: no character of them means anything to the search.
    """
    real = corrections.where((F.trim("right") != "") & (F.trim("wrong") != "") & (F.col("wrong") != F.col("right")))
    lists = real.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("confidence") >= APPLY, F.struct("pos", "wrong", "right")))).alias("c"),
        F.count_if(F.col("confidence") < APPLY).alias("n_suggested"),
        F.count_if(F.col("confidence") < SURE).alias("n_uncertain"),
    )
    joined = docs.join(lists, key, "left")
    literal = lambda w: F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = lambda w: F.concat(F.lit(r"(?iuU)\b\Q"), literal(w), F.lit(r"\E\b"))
    plain = lambda w: F.regexp_replace(w, r"([\\$])", r"\\$1")
    text = F.aggregate(F.coalesce("c", F.array()), F.col("text"), lambda t, c: F.regexp_replace(t, pattern(c["wrong"]), plain(c["right"])))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(key, F.when(F.size("c") > 0, text).otherwise(F.col("text")).alias("text"), count("n_suggested"), count("n_uncertain"))


def noise_variants(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, variant): the distinct deterministic misspellings of each code."""
    c = F.col(code)
    made = [
        c, F.lower(c), F.upper(c), F.regexp_replace(c, r"([A-Za-z])(\d)", "$1 $2"), F.regexp_replace(c, r"([A-Za-z])(\d)", "$1-$2"),
        F.translate(c, "1", "I"), F.translate(c, "1", "l"), F.concat(c, F.lit(" x 5 days")), F.concat(F.lit("after meals "), c),
    ]
    return df.select(key, F.explode(F.array_distinct(F.array(*made))).alias("variant"))


def code_mentions(docs: DataFrame, key: str, codes: Sequence[str], text: str = "text") -> DataFrame:
    """(key, pos, raw) of every mention of a code, in order."""
    known = docs.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    return mentions(docs, key, known, text).select(key, "pos", "raw")


def resolve_chain(tokens: DataFrame, catalog: DataFrame, classify: Callable[[DataFrame], DataFrame] | None = None, least: float = FUZZY_LEAST) -> DataFrame:
    """tokens (id, token) with code and tier: the first tier that knows a code of the catalog (code).

    Tiers: exact, compact, containment, classifier and fuzzy. `classify` takes (id, token) and gives (id, code); codes
    that the catalog doesn't have don't count. Only what a tier leaves open reaches the next one. Equal tokens are
    resolved once; null tokens have no code.
    """
    known = catalog.select("code").where("code IS NOT NULL").distinct()
    texts = tokens.where("token IS NOT NULL").select("token").distinct().select(F.col("token").alias("id"), "token")
    done = resolve_codes(texts, known)
    out = done.where("code IS NOT NULL")
    open_ = done.where("code IS NULL").select("id", "token")
    tiers: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [("containment", lambda t: containment(t, known)), ("fuzzy", lambda t: fuzzy(t, known, least))]
    if classify is not None:
        tiers.insert(1, ("classifier", lambda t: classify(t).select("id", "code").join(known, "code", "left_semi")))
    for name, tier in tiers:
        found = open_.join(tier(open_).select("id", "code"), "id", "left")
        out = out.unionByName(found.where("code IS NOT NULL").select("id", "token", "code", F.lit(name).alias("tier")))
        open_ = found.where("code IS NULL").select("id", "token")
    return tokens.join(out.select("token", "code", "tier"), "token", "left").select("id", "token", "code", "tier")


def annotate_codes(
    docs: DataFrame, catalog: DataFrame, key: str, codes: Sequence[str] | None = None, text: str = "text", classify: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(key, text) with `[Freq → meaning; Instr → instruction]` behind every mention of a code.

    catalog has (code, meaning, instruction). Mentions are those of `codes`, or of the catalog's own, and go through all
    tiers of `resolve_chain`; those that none resolves stay as they are. Of several entries of a code the first by text counts.
    """
    known = catalog.select("code") if codes is None else docs.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    place = lambda start, end: F.substring(F.col("text"), start + 1, end - start)
    rows = with_mentions(docs.select(key, F.col(text).alias("text")), key, known, "text")
    # spellings and what is said of them are kept, so that texts are not read anew by each tier
    spark, raws, said_of = docs.sparkSession, folder(docs.sparkSession, "mentions"), folder(docs.sparkSession, "marks")
    rows.select(F.explode(F.transform("found", lambda m: place(m["start"], m["end"]))).alias("id")).distinct().withColumn("token", F.col("id")).write.parquet(raws)
    tier = resolve_chain(spark.read.parquet(raws), catalog, classify).where("code IS NOT NULL").join(catalog, "code")
    mark = F.concat(F.lit(" [Freq → "), F.coalesce("meaning", F.lit("")), F.lit("; Instr → "), F.coalesce("instruction", F.lit("")), F.lit("]"))
    tier.groupBy(F.col("token").alias("raw")).agg(F.min(mark).alias("mark")).write.parquet(said_of)
    tier = spark.read.parquet(said_of)
    if is_small(tier):
        return marked(rows, key, "text", {r["raw"]: r["mark"] for r in tier.collect()})
    cut = rows.select(key, "text", F.posexplode_outer("found").alias("pos", "m")).withColumn("raw", place(F.col("m.start"), F.col("m.end")))
    shown = cut.join(shuffled(tier), "raw", "left").withColumn("shown", F.concat("raw", F.coalesce("mark", F.lit(""))))
    marks = F.sort_array(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("pos", F.col("m.start").alias("start"), F.col("m.end").alias("end"), "shown"))))
    gathered = shown.groupBy(key).agg(F.first("text").alias("text"), marks.alias("s"))
    before = lambda m: F.when(m["pos"] > 0, F.get("s", m["pos"] - 1)["end"]).otherwise(0)
    pieces = F.transform("s", lambda m: F.concat(place(before(m), m["start"]), m["shown"]))
    rest = F.coalesce(F.get("s", F.size("s") - 1)["end"], F.lit(0))
    return gathered.select(key, F.when(F.size("s") == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), place(rest, F.length("text")))).alias("text"))


def annotations(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, code, meaning): annotated text back to a table of its `[code → meaning]` marks."""
    mark = F.lit(r"\[([^\[\]]*?)\s→\s(.*?)\]")
    both = F.arrays_zip(F.regexp_extract_all(text, mark, F.lit(1)).alias("code"), F.regexp_extract_all(text, mark, F.lit(2)).alias("meaning"))
    return docs.select(key, F.posexplode(both).alias("pos", "a")).select(key, "pos", "a.code", "a.meaning")


def entity_cells(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, cell_no, raw, token): lines of prose whole, without their bullet, and table rows by cell."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    in_table = F.contains("line", F.lit("|")) & ~F.col("line").rlike(r"^[\s|-]+$")
    cells = lines.withColumn("in_table", in_table).select(key, "line_no", "in_table", F.posexplode(F.when(in_table, F.split("line", r"\|")).otherwise(F.array("line"))).alias("cell_no", "raw"))
    trimmed = F.trim("raw")
    prose = F.regexp_replace(F.regexp_replace(trimmed, r"^[-*•]\s+", ""), r"^\d+\.\s+", "")
    token = F.when(F.col("in_table"), trimmed).otherwise(prose)
    skipped = (F.col("in_table") & F.lower(trimmed).isin(*TABLE_LABELS)) | F.col("raw").rlike(r"^[\s|-]*$")
    return cells.select(key, "line_no", "cell_no", "in_table", "raw", F.when(~skipped, token).alias("token"))


def resolve_entities(docs: DataFrame, catalog: DataFrame, key: str, text: str = "text", accept: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """Predictions (key, line_no, cell_no, text, code, name, type, confidence) and the annotated (key, text).

    catalog has (cat_id, code, type, name, meaning, timing). A token that may be an entity is looked up by its
    exact code, else by the nearest name above `accept`; the term found takes its place, with the annotation. Equal
    names are one entry of the index, which stands for the first of them and weighs as many.
    """
    cells = entity_cells(docs, key, text)
    upper = F.upper(F.trim("code"))
    exact = catalog.groupBy(upper.alias("upper")).agg(F.min("cat_id").alias("exact_id"))
    tokens = cells.where("token IS NOT NULL").select("token").distinct().withColumn("upper", F.upper("token")).join(shuffled(exact), "upper", "left")
    asked = tokens.where(entity_candidate(F.col("token"), F.col("exact_id").isNotNull()))
    names = catalog.where("name IS NOT NULL").groupBy("name").agg(F.min("cat_id").alias("cat_id"), F.count("*").alias("n"))
    near = tfidf_nearest(asked.where("exact_id IS NULL").select(F.col("token").alias("id"), "token"), *tfidf_fit(names), accept)
    found = asked.where("exact_id IS NOT NULL").select("token", F.col("exact_id").alias("cat_id"), F.lit(1.0).alias("score"))
    found = found.unionByName(near.select(F.col("id").alias("token"), "cat_id", "score")).join(shuffled(catalog), "cat_id")
    known = found.select("token", "code", F.coalesce("name", "meaning", F.lit("")).alias("name"), "type", "score", F.coalesce("name", "meaning", "token").alias("term"),
                         annotation(F.col("code"), F.col("type"), F.col("name"), F.col("meaning"), F.col("timing")).alias("mark"))
    judged = cells.join(shuffled(known), "token", "left")
    rows = judged.where("code IS NOT NULL").select(key, "line_no", "cell_no", F.col("token").alias("text"), "code", "name", "type", F.format_number("score", 2).alias("confidence"))
    in_cell = F.concat(F.lit(" "), "term", F.lit(" "), "mark", F.lit(" "))
    in_line = F.concat(F.replace("raw", "token", "term"), F.lit(" "), "mark")
    shown = F.when(F.col("code").isNull(), F.col("raw")).when(F.col("in_table"), in_cell).otherwise(in_line)
    lines = judged.groupBy(key, "line_no").agg(F.array_join(F.sort_array(F.collect_list(F.struct("cell_no", shown.alias("s"))))["s"], "|").alias("line"))
    whole = lines.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    return rows, whole


def save_index(vocabulary: DataFrame, index: DataFrame, path: str) -> None:
    """Keep a fitted n-gram index: its vocabulary and its weights."""
    vocabulary.write.parquet(f"{path}/vocabulary")
    index.write.parquet(f"{path}/index")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/index")
