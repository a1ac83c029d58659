"""Job, vault, chat and audit tables: filters, lookups, upserts' set logic and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIVE = ("PENDING", "PROCESSING")


def owned_rows(df: DataFrame, key: str, user: str, pairs: DataFrame) -> DataFrame:
    """Rows whose (key, user) both appear in pairs."""
    return df.join(pairs.select(key, user).distinct(), [key, user], "left_semi")


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; a None value means no predicate."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def newest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The n newest rows; ties by key."""
    return df.orderBy(F.col(ts).desc(), F.col(key)).limit(n)


def newest_per(df: DataFrame, group: str, ts: str, key: str, n: int) -> DataFrame:
    """The n newest rows of each group, with their rank."""
    w = Window.partitionBy(group).orderBy(F.col(ts).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def active_jobs(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Unfinished jobs with the name of their document, null if there is none."""
    return jobs.where(F.col("status").isin(*ACTIVE)).join(names, "doc_id", "left")


def vault_search(df: DataFrame, text: str, query: str, folder: str | None = None, folder_value: str | None = None) -> DataFrame:
    """Optional folder and case-insensitive substring search."""
    found = df.where(F.lower(text).contains(query.lower()))
    return found if folder_value is None else found.where(F.col(folder) == folder_value)


def progress(pages: DataFrame, job: str, done: Column) -> DataFrame:
    """Per job: pages, finished pages and the finished share in percent, rounded to 1."""
    return pages.groupBy(job).agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("done"),
        F.round(100.0 * F.count_if(done) / F.count("*"), 1).alias("progress"),
    )


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, rounded to 2; null if either is missing."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old plus the rows of new whose keys it lacks; the first of equal new keys by the other columns wins."""
    rest = [c for c in new.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*rest) if rest else Window.partitionBy(*keys).orderBy(*keys)
    fresh = new.join(old.select(*keys), list(keys), "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(fresh)


def missing_units(jobs: DataFrame, done: DataFrame, job: str, unit: str, total: str) -> DataFrame:
    """Units 1..total of each job that are not among the done ones."""
    spine = jobs.select(job, F.explode(F.when(F.col(total) >= 1, F.sequence(F.lit(1), F.col(total).cast("int")))).alias(unit))
    return spine.join(done.select(job, unit), [job, unit], "left_anti")


def daily_counts(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of each of the last `days` days up to the newest one, zero filled."""
    last = df.agg(F.max(F.to_date(ts)).alias("last"))
    spine = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    counts = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def streaks(df: DataFrame, user: str, order: Sequence[str], hit: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive hits per user: (user, start order value, length)."""
    everything = Window.partitionBy(user).orderBy(*order)
    hits = Window.partitionBy(user, "hit").orderBy(*order)
    rows = df.withColumn("hit", hit).withColumn("island", F.row_number().over(everything) - F.row_number().over(hits))
    runs = rows.where("hit").groupBy(user, "island").agg(F.min(order[0]).alias("started"), F.max(order[0]).alias("ended"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("island")


def latest_per(df: DataFrame, key: str, ts: Sequence[str], value: str) -> DataFrame:
    """The newest value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*ts)).alias(value))


def over_limit(df: DataFrame, key: str, ts: str, limit: int, width: str = "1 minute") -> DataFrame:
    """Fixed windows in which a key exceeds its limit; works on batches and streams."""
    counted = df.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")
