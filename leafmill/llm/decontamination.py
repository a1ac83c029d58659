"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (document, position, term, term before, term after) for every training token whose
term the benchmark uses, stored as Parquet. For each window of a benchmark item the rarest of its terms gives
candidate places: its postings that have a neighbour of the item beside them, moved back by the term's offset.
The postings of the item's terms within a window of that term are then intersected at these places by
equi-joins, and runs of consecutive matches as long as a window are phrase matches. `proximity_matches` finds
items whose terms all occur near each other in any order.

Only DataFrame functions are used. Nothing but the benchmark's own terms, items and rarest-term anchors and
what was counted small is ever broadcast. A vocabulary of at most VOCABULARY terms is looked up inside the
array of a document's words; a larger one is joined to the exploded words, with the same result.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. An item of fewer
words than a window is one window; one without words matches nothing. Null texts have no words, a null
item_id is named `null`, rows with equal doc_id and equal text are one document, and repeated items count once.
Very long texts are read whole. With an empty benchmark no word is hit; empty documents give an empty result.
Only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leafmill.llm._session import attach, document_key, original_id, scratch, written

WINDOW = 13
VOCABULARY = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NODE = ["doc", "tie"]


def words(text: Column) -> Column:
    """The words of a text, lower-cased; `lower` serves words without non-ASCII characters."""
    low = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), lambda w: w != ""), low)


def node(doc_id: str, text: str) -> list[Column]:
    """The columns that identify a document."""
    return document_key(F.col(doc_id), F.col(text))


@dataclass
class PositionalIndex:
    """postings (doc, tie, pos, term, before, after) of the benchmark's terms; sizes (doc, tie, n_words) of all
    documents; items (item, item_id, n, terms): the words of the benchmark."""

    postings: DataFrame
    sizes: DataFrame
    items: DataFrame


def build_index(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = VOCABULARY) -> PositionalIndex:
    """Store the postings of all documents for all terms of the benchmark."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("w"))
    items = written(items.where(F.size("w") > 0).distinct(), "items")
    vocabulary = written(items.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    tokens = docs.select(*node(doc_id, text), words(F.col(text)).alias("w"))
    term = lambda i: F.xxhash64(F.get("w", i))
    posting = lambda i: F.struct(i.alias("pos"), term(i).alias("term"), term(i - 1).alias("before"), term(i + 1).alias("after"))
    end = F.struct(F.size("w").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("term", "before", "after")])
    if vocabulary.count() <= most:
        known = [r["word"] for r in vocabulary.collect()]
        posts = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(known), posting(i))))
        postings = tokens.select(*NODE, F.inline(F.array_append(posts, end)))
    else:
        used = tokens.select(*NODE, F.posexplode("w").alias("i", "word"), "w").select(*NODE, "word", posting(F.col("i")).alias("p"))
        used = attach(used, vocabulary, ["word"], "left_semi").select(*NODE, "p.*")
        postings = used.unionByName(tokens.select(*NODE, F.inline(F.array(end))))
    postings = written(postings, "postings")
    sizes = postings.where("term IS NULL").select(*NODE, F.col("pos").alias("n_words"))
    items = items.select("item", "item_id", F.size("w").alias("n"), F.transform("w", lambda w: F.xxhash64(w)).alias("terms"))
    return PositionalIndex(postings.where("term IS NOT NULL"), sizes, written(items, "terms"))


def rarest_terms(index: PositionalIndex, window: int = WINDOW) -> DataFrame:
    """(item, off, term, before, after): of each window of each item, its rarest term with its neighbours;
    windows with an unseen term are left out."""
    seen = index.postings.groupBy("term").count()
    spread = index.items.select("item", "n", "terms", F.posexplode("terms").alias("off", "term"))
    beside = lambda i: F.get("terms", F.col("off") + i)
    spread = spread.select("item", "n", "off", "term", beside(-1).alias("before"), beside(1).alias("after"))
    counted = spread.join(seen, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    size = F.least(F.col("n"), F.lit(window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - size + 1), F.least(F.col("off"), F.col("n") - size)))
    rows = counted.select("item", F.struct("count", "off", "term", "before", "after").alias("r"), starts.alias("start"))
    least = rows.groupBy("item", "start").agg(F.min("r").alias("r")).where("r.count > 0")
    return written(least.select("item", "r.off", "r.term", "r.before", "r.after").distinct(), "rarest")


def phrase_matches(index: PositionalIndex, window: int = WINDOW) -> DataFrame:
    """(doc, tie, item, start, n_run, off): runs of at least a window of an item's words in a document."""
    anchors = rarest_terms(index, window).select("item", "term", F.col("off").alias("at"), F.col("before").alias("b"), F.col("after").alias("a"))
    beside = (F.col("before") == F.col("b")) | (F.col("after") == F.col("a")) | (F.col("b").isNull() & F.col("a").isNull())
    if window > 1:
        beside = F.coalesce(beside, F.lit(False))  # any window around the term has one of its neighbours
    else:
        beside = F.lit(True)
    places = attach(index.postings, anchors, ["term"], "inner").where(beside)
    places = written(places.select(*NODE, "item", (F.col("pos") - F.col("at")).alias("base"), "at").distinct(), "places")
    nodes = written(places.select(*NODE).distinct(), "nodes")
    near = attach(index.postings.select(*NODE, "pos", "term"), nodes, NODE, "left_semi")
    first = F.greatest(F.lit(0), F.col("at") - (window - 1))
    wanted = attach(places, index.items.select("item", "n", "terms"), ["item"], "inner")
    wanted = wanted.select(*NODE, "item", "base", "n", first.alias("first"), F.posexplode(F.slice("terms", first + 1, F.col("at") - first + window)).alias("k", "term"))
    wanted = wanted.withColumn("off", F.col("first") + F.col("k")).withColumn("pos", F.col("base") + F.col("off"))
    met = wanted.join(near.hint("merge"), [*NODE, "pos", "term"]).select(*NODE, "item", "base", "off", "n").distinct()
    run = Window.partitionBy(*NODE, "item", "base").orderBy("off")
    runs = met.withColumn("run", F.col("off") - F.row_number().over(run)).groupBy(*NODE, "item", "base", "n", "run")
    runs = runs.agg(F.min("off").alias("off"), F.count("*").cast("int").alias("n_run"))
    runs = runs.where(F.col("n_run") >= F.least("n", F.lit(window)))
    return runs.select(*NODE, "item", (F.col("base") + F.col("off")).alias("start"), "n_run", "off")


def proximity_matches(index: PositionalIndex, slop: int) -> DataFrame:
    """(doc, tie, item): items all of whose distinct terms occur within `slop` words of a posting of the rarest."""
    seen = index.postings.groupBy("term").count()
    terms = index.items.select("item", F.explode("terms").alias("term")).distinct().join(seen, "term", "left")
    rarest = terms.groupBy("item").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term")).alias("r"), F.count("*").alias("n_terms")
    )
    rarest = written(rarest.where("r.count > 0").select("item", "r.term", "n_terms"), "rarest")
    places = attach(index.postings, rarest, ["term"], "inner").select(*NODE, "item", "n_terms", F.col("pos").alias("at")).distinct()
    wanted = places.join(terms.select("item", "term"), "item")
    near = wanted.join(index.postings, [*NODE, "term"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    met = near.groupBy(*NODE, "item", "at", "n_terms").agg(F.count_distinct("term").alias("n_met"))
    return met.where("n_met = n_terms").select(*NODE, "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc, tie, n_words, n_hit, items (sorted item_ids), contaminated."""
    index = build_index(docs, benchmark, doc_id, text)
    runs = written(phrase_matches(index, window), "runs")
    covered = runs.select(*NODE, F.explode(F.sequence("start", F.col("start") + F.col("n_run") - 1)).alias("pos")).distinct()
    hits = covered.groupBy(*NODE).agg(F.count("*").alias("n_hit"))
    names = index.items.select("item", "item_id").distinct()
    found = runs.select(*NODE, "item").distinct().join(names, "item").groupBy(*NODE).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    marks = written(hits.join(found, NODE), "marks")
    out = attach(index.sizes, marks, NODE, "left").select(
        *NODE,
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast(T.ArrayType(T.StringType()))).alias("items"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged.select(
        original_id(F.col("doc"), F.col("tie")).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    with scratch(docs.sparkSession):
        bad = written(contamination(docs, benchmark).where("contaminated").select(*NODE).distinct(), "contaminated", lasting=True)
    rows = docs.select(F.struct("*").alias("row"), *node("doc_id", "text"))
    return attach(rows, bad, NODE, "left_anti").select("row.*")
