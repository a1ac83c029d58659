"""Seams for user-supplied models: batch maps, embeddings, token confidence, fallbacks and prompts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.entities import grams
from leafmill.operators.sized import dealt, if_small
from leafmill.sources.keyed import BUCKETS, KeyedTable

RETRY_UNDER, SMALL = 0.75, 0.3
KEPT = 4  # models of a worker process


def map_model(df: DataFrame, load: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """Apply a model to batches; `load` runs once in each worker process, its result once per batch.

    A worker runs many tasks and keeps the models that it used last.
    """
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(number, load)
        for batch in batches:
            yield model(batch)

    return df.mapInArrow(run, schema)


#: The models of a worker process.
_models: dict[str, Callable[[pa.RecordBatch], pa.RecordBatch]] = {}


def _loaded(number: str, load: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    if number not in _models:
        while len(_models) >= KEPT:
            _models.pop(next(iter(_models)))
        _models[number] = load()
    return _models[number]


def input_digest(df: DataFrame, inputs: Sequence[str]) -> Column:
    """A digest of the inputs of a row, null and empty ones apart."""
    return F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)


def map_model_resumed(
    df: DataFrame, load: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str, inputs: Sequence[str], path: str, buckets: int = BUCKETS
) -> DataFrame:
    """df with the model's outputs, computed only for inputs that have no result under path yet.

    The model gets the columns `inputs` and `digest` of distinct inputs, and gives `digest` and the outputs of schema.
    Results are kept in a keyed table by digest, which a run that was cut short leaves as it was before.
    """
    spark = df.sparkSession
    outputs = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    held = T.StructType([T.StructField("digest", T.StringType()), *outputs.fields])
    table = KeyedTable.create(spark, path, held, ["digest"], buckets)
    asked = df.select(*inputs).distinct().withColumn("digest", input_digest(df, inputs))
    new = asked.join(table.read().select("digest"), "digest", "left_anti").select("digest", *inputs)
    if not new.isEmpty():
        table.upsert(map_model(new, load, held))
    return df.withColumn("digest", input_digest(df, inputs)).join(table.read(), "digest", "left").drop("digest")


def hashed_embedding(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, v): L2-normalised counts of hashed character 3-grams of names and lines, an embedding without a model.

    Rows are dealt by key to parts of bounded size, in which grams are counted without another shuffle.
    """
    places = dealt(df.select(key, text), key, rows=50_000).select(key, F.explode(grams(F.col(text), 3, 3)).alias("g")).groupBy(key, F.pmod(F.xxhash64("g"), F.lit(size)).cast("int").alias("k")).agg(F.count("*").alias("n"))
    gathered = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    v = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0)) / F.col("norm"))
    return gathered.select(key, v.alias("v"))


def token_confidence(rows: DataFrame, key: str, logprob: str) -> DataFrame:
    """(key, confidence): exp of the mean log-probability; 0 without tokens."""
    return rows.groupBy(key).agg(F.coalesce(F.round(F.exp(F.avg(logprob)), 6), F.lit(0.0)).alias("confidence"))


def best_of_two(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first (key, text, conf, area, page_area) with the fallback (key, text, conf) where that is better.

    The fallback replaces an empty or unsure text of a small region if it says something with more confidence.
    """
    both = first.join(second.select(key, F.col("text").alias("_t"), F.col("conf").alias("_c")), key, "left")
    weak = (F.trim("text") == "") | (F.col("conf") < RETRY_UNDER)
    take = F.coalesce(weak & (F.col("area") < SMALL * F.col("page_area")) & (F.trim("_t") != "") & (F.col("_c") > F.col("conf")), F.lit(False))
    return both.select(key, F.when(take, F.col("_t")).otherwise(F.col("text")).alias("text"), F.when(take, F.col("_c")).otherwise(F.col("conf")).alias("conf"), take.alias("fallback"))


def prompts(df: DataFrame, templates: DataFrame, kind: str) -> DataFrame:
    """Rows with the prompt of their kind, {name} filled from the column of that name; a template or two is broadcast, many are not."""
    joined = df.join(if_small(templates), kind)
    prompt = F.col("template")
    for name in df.columns:
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return joined.withColumn("prompt", prompt).drop("template")
