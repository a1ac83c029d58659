"""Versioned Parquet sinks: append, upsert by key, scoped delete, keyed update and resumable results.

A table is a folder of versions v=1, v=2, ...; a change reads the newest and writes the next, so no path is
overwritten while it is read, and a failed write leaves the old version in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows take the place of old rows with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replaced(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """All old rows of the scopes that new brings go, also those that new no longer has."""
    return upserted(old, new, scope)


def deleted(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def updated(old: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """old with the changed values of one column, and whether a change met the row.

    Of several changes of one key the highest value wins, so no row is doubled.
    """
    new = changes.groupBy(key).agg(F.max(column).alias("_new"), F.lit(True).alias("_met"))
    rows = old.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).withColumn("changed", F.coalesce("_met", F.lit(False)))
    return rows.drop("_new", "_met")


def pending(work: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """Work whose result is missing or empty."""
    return work.join(results.where(F.trim(F.coalesce(value, F.lit(""))) != "").select(key).distinct(), key, "left_anti")


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest complete version under path, 0 if there is none; asks the path's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return 0
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((int(n[2:]) for n in done if n.startswith("v=")), default=0)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={latest_version(spark, path)}")


def write_table(df: DataFrame, path: str) -> int:
    """Write df as the next version."""
    version = latest_version(df.sparkSession, path) + 1
    df.write.parquet(f"{path}/v={version}")
    return version


def append(df: DataFrame, path: str) -> int:
    """Add rows to a table as part of its newest version, so read_table sees them; starts it if there is none."""
    version = max(1, latest_version(df.sparkSession, path))
    df.write.mode("append").parquet(f"{path}/v={version}")
    return version


def export_markdown(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.text(path)
