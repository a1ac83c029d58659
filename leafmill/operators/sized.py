"""Broadcasts of sides whose size is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, BYTES = 50_000, 8 << 20


def is_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Has df at most so many rows and characters?"""
    length = F.length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    counted = df.select(length.alias("n")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return counted[0] <= rows and counted[1] <= size


def if_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and characters; else as it is, to be shuffled."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def shuffled(df: DataFrame) -> DataFrame:
    """df marked for a shuffled join: sizes that Spark guesses from files know nothing of compression and exploded rows."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str, rows: int = 250_000, least: int = 2_000) -> DataFrame:
    """df by its keys in parts of about so many rows, so that a task's memory doesn't grow with the table; in fewer rows
    where that gives each core a part, since a small file is one part whatever is made of its rows."""
    spark, n = df.sparkSession, df.count()
    return df.repartition(max(1, -(-n // rows), min(spark.sparkContext.defaultParallelism, -(-n // least))), *keys)
