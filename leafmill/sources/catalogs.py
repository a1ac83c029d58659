"""Reading and writing catalogs: dirty legacy rows, JSON in two shapes, content hashes, encrypted payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, length) of binary files, distinct by content; the first path of equal contents stays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return first_seen(files.select("path", F.md5("content").alias("md5"), "length"), "md5", "path", "path")


def first_seen(df: DataFrame, digest: str, order: str, name: str) -> DataFrame:
    """One row per digest with the name that came first and how often it came."""
    return df.groupBy(digest).agg(F.min_by(name, order).alias("name"), F.min(order).alias("first"), F.count("*").alias("n"))


def union_sheets(sheets: dict[str, DataFrame], code: str) -> DataFrame:
    """All sheets as one table with their name in SHEET; blank and `nan` codes are dropped."""
    out = None
    for name, df in sheets.items():
        named = df.withColumn("SHEET", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.where((F.trim(code) != "") & (F.lower(F.trim(code)) != "nan"))


def catalog_to_json(df: DataFrame, key: str) -> DataFrame:
    """(json): one JSON object for each row, keyed by its code."""
    return df.select(F.to_json(F.create_map(F.col(key), F.struct(*[c for c in df.columns if c != key]))).alias("json"))


def catalog_from_json(df: DataFrame, column: str, key: str, schema: str) -> DataFrame:
    """Rows of JSON catalogs: objects keyed by code, or arrays of records; NaN becomes null."""
    text = F.regexp_replace(column, r":\s*NaN\b", ": null")
    keyed = df.where(~F.ltrim(column).startswith("[")).select(F.explode(F.from_json(text, f"map<string,struct<{schema}>>")).alias(key, "r")).select(key, "r.*")
    listed = df.where(F.ltrim(column).startswith("[")).select(F.inline(F.from_json(text, f"array<struct<{key}:string,{schema}>>")))
    return keyed.unionByName(listed)


def int_or_null(c: Column) -> Column:
    return c.try_cast("int")


def json_or_empty(c: Column) -> Column:
    """The text itself if it is JSON, else an empty object."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise("{}")


def skip_known(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(known.select(*keys), list(keys), "left_anti")


def encrypted(c: Column, key: Column) -> Column:
    return F.aes_encrypt(c, key, F.lit("GCM"))


def decrypted_or_plain(c: Column, key: Column) -> Column:
    """Rows that the key does not open pass through as they are."""
    return F.coalesce(F.try_aes_decrypt(c, key, F.lit("GCM")), c).cast("string")


def with_default(df: DataFrame, column: str, default: object) -> DataFrame:
    """A column that old files lack, or hold as null, with its default."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default))
