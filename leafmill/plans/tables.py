"""Driver tables, the registration decorator and the fixtures that several queries derive from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'PROCESSING' WHEN 'P' THEN 'PENDING' ELSE 'COMPLETED' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status(code: Column) -> Column:
    return F.when(code == "O", "PROCESSING").when(code == "P", "PENDING").otherwise("COMPLETED")


def query(queries: dict, oracles: dict[str, str]) -> Callable:
    """A decorator that registers a query under its function's name, with its SQL if there is any."""

    def register(sql: str | None = None) -> Callable:
        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return register
