"""A lexical index that is kept: postings by range of chunks with bounds, appended to, and searched without the texts.

Chunks are dealt to ranges by a hash of their ids. A row of the index is one term in one range: how often each of its
chunks has the term, their lengths, and a bound of what the term can add to any score there (from its highest count
and the shortest chunk). A search first adds up the bounds of its terms for each range, scores the best ranges, and
takes the k-th best score so far as a threshold. Of the other ranges only those whose bounds reach it are scored.
So ranges that cannot enter are never opened, and the result is that of scoring all of them.

Each batch is appended under a number of its own; statistics are sums over the batches' own small tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leafmill.operators.retrieval import QUERY_TERMS, tokens, top_k
from leafmill.operators.term_scores import K1, Asked, B, best_rows, few

RANGE_CHUNKS = 256  # about
TASK_CHUNKS = 4_096
FIRST = 8  # ranges of each query that are scored for a threshold


@dataclass(frozen=True)
class LexicalIndex:
    """postings (term, range, batch, most_tf, least_dl, chunks) and stats (n_chunks, words, ranges)."""

    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/postings")

    @property
    def frequencies(self) -> DataFrame:
        """(term, df) over all batches."""
        return self.spark.read.parquet(f"{self.path}/frequencies").groupBy("term").agg(F.sum("df").alias("df"))

    @property
    def stats(self) -> tuple[int, int]:
        """Chunks and words of all batches."""
        row = self.spark.read.parquet(f"{self.path}/stats").agg(F.sum("n_chunks"), F.sum("words")).first()
        return row[0] or 0, row[1] or 0


def create(chunks: DataFrame, path: str, ranges: int | None = None) -> LexicalIndex:
    """Start an index with chunks (chunk_id, text). `ranges` stays as it is for later batches."""
    spark = chunks.sparkSession
    found = ranges or max(1, -(-chunks.count() // RANGE_CHUNKS))
    spark.createDataFrame([(found,)], "ranges int").write.parquet(f"{path}/ranges")
    return append(chunks, LexicalIndex(spark, path))


def append(chunks: DataFrame, index: LexicalIndex) -> LexicalIndex:
    """Add a batch of new chunks; old files stay as they are. Null texts are no chunks, empty ones are.

    Only texts are shuffled, to the task that makes the postings of their range; a range of many more chunks than
    RANGE_CHUNKS is made in slices.
    """
    spark = index.spark
    ranges = spark.read.parquet(f"{index.path}/ranges").first()[0]
    batch = uuid.uuid4().hex
    known = chunks.where("text IS NOT NULL")
    n = known.count()
    slices = max(1, n // (ranges * RANGE_CHUNKS))
    dealt = known.select(
        "chunk_id", "text", F.pmod(F.xxhash64("chunk_id"), F.lit(ranges)).cast("int").alias("range"), F.pmod(F.hash("chunk_id"), F.lit(slices)).alias("slice")
    ).repartition(_parts(spark, n), "range", "slice")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = dealt.select("chunk_id", "range", "slice", tokens(F.col("text")).alias("t")).groupBy("range", "slice")
    place = f"{index.path}/postings/batch={batch}"
    rows.applyInArrow(_postings, f"term string, range int, most_tf int, least_dl int, chunks array<struct<chunk_id:{kind},tf:int,dl:int>>").write.parquet(place)
    written = spark.read.parquet(place)
    words = F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["tf"])
    written.groupBy("term").agg(F.sum(F.size("chunks")).alias("df"), F.sum(words).alias("words")).write.parquet(f"{index.path}/frequencies/batch={batch}")
    counted = spark.read.parquet(f"{index.path}/frequencies/batch={batch}").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"))
    counted.select(F.lit(n).cast("long").alias("n_chunks"), "words").write.parquet(f"{index.path}/stats/batch={batch}")
    return index


def _parts(spark: SparkSession, n: int) -> int:
    """Tasks for so many chunks."""
    return max(spark.sparkContext.defaultParallelism, -(-n // TASK_CHUNKS))


def _postings(rows: pa.Table) -> pa.Table:
    """The rows of the index of one range, from its chunks and their tokens; the terms in order, their chunks too."""
    rows = rows.sort_by("chunk_id").combine_chunks()
    t = rows["t"].combine_chunks()
    dl = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = t.flatten().dictionary_encode()
    ranked = pc.rank(words.dictionary, tiebreaker="dense").to_numpy().astype(np.int64) - 1
    owner, n = np.repeat(np.arange(len(dl)), dl), max(1, len(dl))
    pairs, tf = np.unique(ranked[words.indices.to_numpy(zero_copy_only=False)] * n + owner if len(owner) else np.zeros(0, np.int64), return_counts=True)
    term, chunk = pairs // n, pairs % n
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    least, most = (f.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64) for f, x in ((np.minimum, dl[chunk]), (np.maximum, tf)))
    found = pa.StructArray.from_arrays([rows["chunk_id"].combine_chunks().take(pa.array(chunk)), pa.array(tf.astype(np.int32)), pa.array(dl[chunk].astype(np.int32))], names=["chunk_id", "tf", "dl"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)).astype(np.int32)), found)
    number = pa.array(np.full(len(starts), rows["range"][0].as_py(), np.int32))
    return pa.table({"term": words.dictionary.take(pc.sort_indices(words.dictionary)), "range": number, "most_tf": pa.array(most.astype(np.int32)), "least_dl": pa.array(least.astype(np.int32)), "chunks": lists})


def _weight(tf: Column, dl: Column, idf: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def search(queries: DataFrame, index: LexicalIndex, k: int, use_idf: bool = True, first: int = FIRST, most: int = QUERY_TERMS) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries (query_id, text): the k best by term weights, no text is read.

    Up to `most` terms and a bounded number of (query, term) pairs are sent to the tasks, which bound and score whole
    ranges; larger batches of queries are joined to the postings.
    """
    return _searched(queries, index, k, use_idf, first, most)[0]


def opened(queries: DataFrame, index: LexicalIndex, k: int, first: int = FIRST) -> tuple[int, int]:
    """How many of the (query, range) pairs that share a term a search opens, and of how many."""
    _, some, bounds = _searched(queries, index, k, True, first, QUERY_TERMS)
    return some.count(), bounds.count()


def _searched(queries: DataFrame, index: LexicalIndex, k: int, use_idf: bool, first: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, words = index.stats
    average = words / n if words else 1.0
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) if use_idf else F.lit(1.0)
    batch = few(asked, most)
    by = _by_joins(index, asked, idf, average) if batch is None else _in_tasks(index, asked, batch, idf, average, k, n)
    bounds, scores, ids = by
    ranked = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "range")))
    start = top_k(scores(ranked.where(F.col("place") <= first)), ["query"], "score", ["chunk_id"], k).drop("rank")
    threshold = start.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
    rest = ranked.where(F.col("place") > first).join(threshold, "query").where(F.col("most") >= F.col("least") - 1e-6).select("query", "range", "place", "most")
    best = top_k(start.unionByName(scores(rest)), ["query"], "score", ["chunk_id"], k)
    return ids(best).select("query_id", "chunk_id", "score", "rank"), ranked.where(F.col("place") <= first).unionByName(rest.select(*ranked.columns)), ranked


def _in_tasks(index: LexicalIndex, asked: DataFrame, batch: Asked, idf: Column, average: float, k: int, n: int) -> tuple[DataFrame, Callable, Callable]:
    """Bounds (query, range, most) and scores of (query, range) pairs, by ranges that are gathered in tasks; queries are
    numbers. Where few queries are asked, few of the postings are."""
    spark = index.spark
    known = spark.createDataFrame(list(enumerate(batch.terms)), "number int, term string")
    weights = np.zeros(len(batch.terms))
    for r in index.frequencies.join(F.broadcast(known), "term").select("number", idf.alias("idf")).collect():  # at most those of the queries
        weights[r["number"]] = r["idf"]
    shared, parts = spark.sparkContext.broadcast((batch, weights)), _parts(spark, n)
    kind = index.postings.schema["chunks"].dataType.elementType["chunk_id"].dataType.simpleString()

    def bounded(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        batch, idf = shared.value
        number, tf, dl = (rows[c].to_numpy().astype(float) for c in ("number", "most_tf", "least_dl"))
        most = np.zeros(len(batch.terms))
        np.maximum.at(most, number.astype(np.int64), idf[number.astype(np.int64)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average)))
        sums = batch.bounds(most)
        query = np.flatnonzero(sums > 0).astype(np.int32)
        return pa.table({"query": query, "range": pa.array([key[0].as_py()] * len(query), pa.int32()), "most": sums[query]})

    def scored(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        batch, idf = shared.value
        lists = rows["chunks"].combine_chunks()
        number = np.repeat(rows["number"].to_numpy(), lists.value_lengths().to_numpy()) if len(rows) else np.zeros(0, np.int64)
        flat = lists.flatten()
        found = flat.field(0).dictionary_encode()
        place, tf, dl = (x.to_numpy(zero_copy_only=False) for x in (found.indices, flat.field(1), flat.field(2)))
        wanted, out = pairs["query"].to_numpy(), []
        for lo in range(0, len(found.dictionary) if len(wanted) else 0, batch.rows):
            ids = found.dictionary.slice(lo, batch.rows)
            here = (place >= lo) & (place < lo + batch.rows)
            counts, lengths = np.zeros((len(ids), len(batch.terms))), np.zeros(len(ids))
            counts[place[here] - lo, number[here]] = tf[here]
            lengths[place[here] - lo] = dl[here]
            out.append(batch.best(counts, lengths, ids, idf, average, k, wanted))
        best = best_rows(pa.concat_tables(out), k) if out else pa.table({"query": pa.array([], pa.int64()), "chunk_id": found.dictionary.slice(0, 0), "score": pa.array([], pa.float64())})
        return best.set_column(0, "query", best["query"].cast(pa.int32()))

    def scores(pairs: DataFrame) -> DataFrame:
        rows = index.postings.select("term", "range", "chunks").join(F.broadcast(known), "term").select("range", "number", "chunks").repartition(parts, "range")
        asked_of = pairs.select("range", "query").repartition(parts, "range")
        return rows.groupBy("range").cogroup(asked_of.groupBy("range")).applyInArrow(scored, f"query int, chunk_id {kind}, score double")

    heads = index.postings.select("term", "range", "most_tf", "least_dl").join(F.broadcast(known), "term").select("range", "number", "most_tf", "least_dl")
    bounds = heads.groupBy("range").applyInArrow(bounded, "query int, range int, most double")
    numbered = spark.createDataFrame(list(enumerate(batch.queries)), T.StructType([T.StructField("query", T.IntegerType()), asked.schema["query_id"]]))
    return bounds, scores, lambda best: best.join(F.broadcast(numbered), "query")


def _by_joins(index: LexicalIndex, asked: DataFrame, idf: Column, average: float) -> tuple[DataFrame, Callable, Callable]:
    """The same by joins and groups, for queries of any number."""
    asked = asked.join(index.frequencies, "term").select(F.col("query_id").alias("query"), "term", idf.alias("idf"))
    # the columns without the postings themselves
    heads = index.postings.select("term", "range", "most_tf", "least_dl").join(asked, "term")
    most = heads.withColumn("most", _weight(F.col("most_tf"), F.col("least_dl"), F.col("idf"), average))
    per_term = most.groupBy("query", "range", "term").agg(F.max("most").alias("most"))  # of several batches the highest

    def scores(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query", "range").join(asked, "query")
        rows = index.postings.select("term", "range", "chunks").join(wanted, ["term", "range"]).select("query", "idf", F.inline("chunks"))
        summed = rows.groupBy("query", "chunk_id").agg(F.sum(_weight(F.col("tf"), F.col("dl"), F.col("idf"), average)).alias("score"))
        return summed.select("query", "chunk_id", F.round("score", 6).alias("score"))

    return per_term.groupBy("query", "range").agg(F.sum("most").alias("most")), scores, lambda best: best.withColumnRenamed("query", "query_id")
