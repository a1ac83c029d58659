"""Structured Streaming twins of the batch operators. Each takes and returns DataFrames or starts a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.jobs import over_limit
from leafmill.sources.keyed import BUCKETS, KeyedTable


def read_json(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def read_parquet(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a rerun with the same checkpoint takes only what is new."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start()


def completed(pages: DataFrame, job: str, total: str, page: str) -> DataFrame:
    """Jobs whose pages have all arrived (update mode): the expected total travels with each page.

    A replayed page counts once. The state is the page numbers of each job seen.
    """
    counts = pages.groupBy(job).agg(F.size(F.collect_set(page)).cast("long").alias("done"), F.max(total).alias("total"))
    return counts.where(F.col("done") >= F.col("total"))


def latest(log: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest value of each key (update mode)."""
    return log.groupBy(key).agg(F.max_by(value, ts).alias(value))


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Keys over their limit in a fixed window, late events dropped after `late`."""
    return over_limit(events.withWatermark(ts, late), key, ts, limit)


def sse_tokens(lines: Column) -> Column:
    """The payload of `data: {...}` lines."""
    return F.from_json(F.regexp_replace(lines, r"^data:\s*", ""), "type string, session long, seq long, token string, citations array<string>")


def assemble(tokens: DataFrame) -> DataFrame:
    """(session, text, citations) of tokens (session, seq, token, type, citations) of finished sessions, in order.

    Citations come once, in a row of type `citations`. Works on batches and, in update or complete mode, on
    streams; a session's state is its own tokens.
    """
    token = F.when(F.col("type") == "token", F.struct("seq", "token"))
    cited = F.when(F.col("type") == "citations", F.struct(F.col("seq").alias("seq"), "citations"))
    gathered = tokens.groupBy("session").agg(F.collect_list(token).alias("t"), F.min(cited).alias("c"), F.max((F.col("type") == "done").cast("int")).alias("done"))
    return gathered.where("done = 1").select("session", F.array_join(F.array_sort("t")["token"], " ").alias("text"), F.coalesce("c.citations", F.array()).alias("citations"))


def upsert_to(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Each micro-batch replaces rows with its keys in a keyed table; a replayed batch changes nothing.

    Only the buckets that a batch touches are rewritten. Of several rows of one key in a batch the one with the
    highest other columns stays.
    """
    table = KeyedTable.create(stream.sparkSession, path, stream.schema, keys, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, checkpoint, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantine(rows: DataFrame, ok: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their reason and status FAILED unless they were completed."""
    failed = F.when(F.col("status") == "COMPLETED", F.col("status")).otherwise("FAILED")
    return rows.where(F.coalesce(ok, F.lit(False))), rows.where(~F.coalesce(ok, F.lit(False))).withColumn("status", failed).withColumn("reason", reason)
