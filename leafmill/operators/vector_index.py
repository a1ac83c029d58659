"""Approximate dense search: coarse cells with residual codes, kept as Parquet, and an exact rerank of what is probed.

Vectors are scaled to norm 1 and go to the nearest of some cells, whose centres k-means finds on a bounded sample. What
is left of a vector after its cell's centre is taken off is kept as one byte a dimension. Blocks hold the codes of up to
about BLOCK vectors of one tenant and cell in one row. A search probes the nearest cells of each query: blocks of
queries meet blocks of codes, so a task multiplies two small matrices; the best by code are compared exactly, and only
the blocks that hold some of them are read for that. Codes take an eighth of the bytes of double vectors.

A tenant or cell of any size spreads over its blocks; every vector is indexed. Zero and null vectors are never found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.retrieval import top_k

SAMPLE = 50_000  # vectors that the cells are learned from, about
MOST_CELLS = 4_096
BLOCK = 4_096  # vectors
QUERY_BLOCK = 256
PROBED = 0.8  # of the cells
SPARE = 8  # times k: candidates by code that are compared exactly
FEW = 64  # queries whose blocks a filter names


@dataclass(frozen=True)
class VectorIndex:
    """blocks (block, tenant, cell, ids, scales, codes, exact) and the centres of the cells."""

    blocks: DataFrame
    centres: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(df: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("norm", norm).where("norm > 0").withColumn("v", F.transform("v", lambda x: x.cast("double") / F.col("norm"))).drop("norm")


def _centres(unit: DataFrame, cells: int, seed: int) -> np.ndarray:
    """At most `cells` centres from about SAMPLE vectors, chosen by a hash of their ids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = unit.count()
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    sample = unit.where(part < min(1.0, SAMPLE / max(1, total))).select(array_to_vector("v").alias("features"))
    if sample.isEmpty():
        return np.zeros((0, 0))
    return np.array(KMeans(k=max(2, cells), seed=seed, maxIter=10).fit(sample).clusterCenters())


def _coded(centres: np.ndarray) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Cell, scale and code of each vector."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            v = _matrix(batch)
            cell = (v @ centres.T - (centres**2).sum(1) / 2).argmax(1) if len(v) else np.zeros(0, int)
            rest = v - centres[cell] if len(v) else v
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127 if len(v) else np.zeros(0)
            codes = np.rint(rest / scale[:, None]).astype(np.int8) if len(v) else rest
            arrays = [pa.array(cell, pa.int32()), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in v], pa.binary())]
            yield pa.StructArray.from_arrays(arrays, names=["cell", "scale", "code", "exact"])

    return run


def build_index(vectors: DataFrame, tenant: str, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Index vectors (id, tenant, v) under path. `cells` is the root of their number by default."""
    unit = _unit(vectors.where("v IS NOT NULL").select("id", F.col(tenant).alias("tenant"), "v"))
    spark = vectors.sparkSession
    found = cells or min(MOST_CELLS, int(unit.count() ** 0.5) + 1)
    centres = _centres(unit, found, seed)
    width = centres.shape[1] if centres.size else 0
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    code = F.arrow_udf(_coded(centres), "cell int, scale double, code binary, exact binary", functionType=F.ArrowUDFType.SCALAR_ITER)
    unit.where(F.size("v") == width).select("id", "tenant", code("v").alias("c")).select("id", "tenant", "c.*").write.parquet(f"{path}/codes")
    codes = spark.read.parquet(f"{path}/codes")
    sizes = codes.groupBy(F.col("tenant").alias("t"), F.col("cell").alias("c")).agg(F.count("*").alias("n"))
    dealt = codes.join(sizes, _same("tenant", "t") & (F.col("cell") == F.col("c"))).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
    rows = F.sort_array(F.collect_list(F.struct("id", "scale", "code", "exact")))  # about BLOCK vectors
    blocks = dealt.groupBy("tenant", "cell", "part").agg(rows.alias("r"))
    joined = lambda c: F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x[c])), "")).alias(c)
    blocks = blocks.select(
        F.xxhash64("tenant", "cell", "part").alias("block"), "tenant", "cell", F.col("r.id").alias("ids"), F.col("r.scale").alias("scales"), joined("code"), joined("exact")
    )
    blocks.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.parquet(f"{path}/blocks")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index as it was written."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    return VectorIndex(spark.read.parquet(f"{path}/blocks"), np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0)))


def _nearest(centres: np.ndarray, probes: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            order = np.argsort(-(_matrix(batch) @ centres.T), axis=1, kind="stable")[:, :probes] if len(batch) else np.zeros((0, 0), int)
            yield pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))

    return run


def _best_by_code(centres: np.ndarray, spare: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The `spare` best of each block for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda c: batch.column(c)[row]  # noqa: B023, E731
                ids = np.asarray(at("ids").values)
                codes = np.frombuffer(at("code").as_py(), np.int8).reshape(len(ids), -1)
                v = codes * np.asarray(at("scales").values)[:, None] + centres[at("cell").as_py()]
                queries = at("queries").values
                scores = _matrix(queries.field("v")) @ v.T
                asked = np.asarray(queries.field("id"))
                scores[asked[:, None] == ids[None, :]] = -np.inf  # not itself
                most = min(spare, len(ids))
                best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                arrays = [np.repeat(asked, most), np.full(best.size, at("block").as_py()), ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "block", "vec_id", "near"]).filter(pa.array(np.isfinite(arrays[3])))

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            at = lambda c: batch.column(c)[row]  # noqa: B023, E731
            ids = np.asarray(at("ids").values)
            v = np.frombuffer(at("exact").as_py(), "<f8").reshape(len(ids), -1)
            pairs = at("pairs").values
            order = np.argsort(ids, kind="stable")
            place = order[np.searchsorted(ids, np.asarray(pairs.field("vec_id")), sorter=order)]
            score = (_matrix(pairs.field("v")) * v[place]).sum(1)
            yield pa.RecordBatch.from_arrays([pairs.field("query_id"), pairs.field("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])


def search(queries: DataFrame, index: VectorIndex, tenant: str, k: int, probed: float = PROBED, spare: int = SPARE) -> DataFrame:
    """(query_id, vec_id, score, rank): nearly the k best by cosine within each query's tenant, from queries (id, tenant, v).

    `probed` is the share of cells that a query meets. Scores are exact, ties go by id. Queries of another width or
    without length find nothing.
    """
    empty = "query_id long, vec_id long, score double"
    if not index.centres.size:
        return top_k(queries.sparkSession.createDataFrame([], empty), ["query_id"], "score", ["vec_id"], k)
    cells, width = index.centres.shape
    asked = _unit(queries.where("v IS NOT NULL").select("id", F.col(tenant).alias("tenant"), "v")).where(F.size("v") == width)
    near = F.arrow_udf(_nearest(index.centres, max(1, round(cells * probed))), "array<int>", functionType=F.ArrowUDFType.SCALAR_ITER)
    probes = asked.select("id", "tenant", "v", F.explode(near("v")).alias("cell"))
    counts = asked.groupBy("tenant").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    dealt = probes.join(counts.withColumnRenamed("tenant", "t"), _same("tenant", "t")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = dealt.groupBy("tenant", "cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    blocks = blocks.withColumnsRenamed({"tenant": "t", "cell": "c"})
    met = index.blocks.drop("exact").join(blocks, _same("tenant", "t") & (F.col("cell") == F.col("c"))).select("block", "cell", "ids", "scales", "code", "queries")
    found = met.mapInArrow(_best_by_code(index.centres, spare * k), "query_id long, block long, vec_id long, near double")
    best = top_k(found, ["query_id"], "near", ["vec_id"], spare * k).select("query_id", "block", "vec_id")
    pairs = best.join(asked.select(F.col("id").alias("query_id"), "v"), "query_id")
    spread = pairs.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(16)))  # a block that many queries want is met in parts
    spread = spread.groupBy("block", "part").agg(F.collect_list(F.struct("query_id", "vec_id", "v")).alias("pairs"))
    held = index.blocks.select("block", "ids", "exact")
    if asked.limit(FEW + 1).count() <= FEW:
        named = best.select("block").distinct().collect()  # at most FEW * spare * k
        held = held.where(F.col("block").isin([r["block"] for r in named]))
    scored = held.join(spread, "block").select("ids", "exact", "pairs").mapInArrow(_exact, empty)
    return top_k(scored.withColumn("score", F.round("score", 6)), ["query_id"], "score", ["vec_id"], k)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
