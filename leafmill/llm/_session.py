"""Lineage cuts and size-checked joins shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a side that may be broadcast; a larger side is shuffled instead.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 8 << 20
LAST = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local session gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-leafmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: The folders of tables written inside each open `scratch`, of each thread or task of the driver.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end, but for lasting ones. Nothing lazy may read them later."""
    own: list[str] = []
    before = _scratch.set((*_scratch.get(), own))
    try:
        yield
    finally:
        _scratch.reset(before)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, own):
            path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: compact, columnar, no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    owners = _scratch.get()[:-1] if lasting else _scratch.get()
    if owners:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def document_key(doc_id: Column, text: Column) -> list[Column]:
    """The columns doc and tie: the place of a document in the order (null doc_id last) and its identity.

    tie tells texts of one doc_id apart. It is negative but for null doc_ids, so these come after the largest one.
    """
    number = doc_id.cast("long")
    hashed = F.xxhash64(F.coalesce(text, F.lit("")))
    tie = F.when(number.isNull(), hashed.bitwiseAND(F.lit(LAST))).otherwise(hashed.bitwiseOR(F.lit(-LAST - 1)))
    return [F.coalesce(number, F.lit(LAST)).alias("doc"), tie.alias("tie")]


def original_id(doc: Column, tie: Column) -> Column:
    """The doc_id behind a document key."""
    return F.when(tie < 0, doc)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of one value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(column), F.lit(0)) * 16 + 16
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table stays under both bounds, by counting all of it."""
    width = sum((_width(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(0))
    counted = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return counted[0] <= rows and counted[1] <= size


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a written right side: broadcast while its counted rows and bytes stay under the bounds, shuffled beyond."""
    return left.join(F.broadcast(right) if is_small(right) else right.hint("merge"), list(on), how)
