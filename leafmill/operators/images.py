"""Statistics, fingerprints and decisions over pixel arrays and page scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import let

INK, LEAST_SCORE, MARGIN = 0.01, 0.5, 1.3
SIDE, LOW = 32, 8  # fixed values: pixels a side that an image is scaled to, and frequencies a side that are kept


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def quantiles(px: Column, *shares: float) -> Column:
    """Linear-interpolated quantiles of an array as an array; the pixels are sorted once. Null without pixels."""

    def at(s: Column, q: float) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return let(F.array_sort(px), lambda s: F.array(*[at(s, q) for q in shares]))


def blank_pages(images: DataFrame, px: str = "px", threshold: float = INK) -> DataFrame:
    """images with ink, the share of pixels darker than the median less 30, and is_blank."""
    dark = let(quantiles(F.col(px), 0.5)[0], lambda m: F.size(F.filter(px, lambda p: p < m - 30))) / F.size(px)
    return images.withColumn("ink", F.round(dark, 6)).withColumn("is_blank", F.col("ink") < threshold)


def stretch(px: Column) -> Column:
    """Contrast stretched from the 2nd to the 98th percentile, clipped to 0..255."""
    value = lambda p, q: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (p - q[0]) * 255.0 / F.greatest(q[1] - q[0], F.lit(1.0))))
    return let(quantiles(px, 0.02, 0.98), lambda q: F.transform(px, lambda p: value(p, q)))


def projection_variance(px: Column, width: int, height: int) -> Column:
    """Population variance of the row sums."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.aggregate(F.slice(px, r * width + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x))
    return _mean(F.transform(rows, lambda x: x * x)) - _mean(rows) * _mean(rows)


def winner(scores: DataFrame, page: str, candidate: str, score: str, default: int = 0) -> DataFrame:
    """(page, winner): the best candidate if it is good enough and far enough ahead, else the default."""
    w = Window.partitionBy(page).orderBy(F.col(score).desc(), candidate)
    ranked = scores.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_n = 1")
    sure = (F.col(score) >= LEAST_SCORE) & (F.col("_next").isNull() | (F.col(score) >= MARGIN * F.col("_next")))
    return ranked.select(page, F.when(sure, F.col(candidate)).otherwise(default).alias("winner"))


def _scaling(size: int) -> np.ndarray:
    """Averages of `size` pixels over SIDE equal stretches."""
    edges = np.linspace(0, size, SIDE + 1)
    at = np.arange(size)
    share = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.maximum(share, 0) * SIDE / size


def perceptual_hash(px: np.ndarray, width: int) -> int:
    """64 bits of an image: which of its LOW * LOW lowest frequencies are above their median."""
    image = px.reshape(-1, width)
    small = _scaling(image.shape[0]) @ image @ _scaling(width).T
    waves = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE) + 1) / (2 * SIDE))
    low = np.round(waves @ small @ waves.T, 6).ravel()
    return int.from_bytes(np.packbits(low > np.median(low)).tobytes(), "big", signed=True)


def _hashes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pixels, widths in batches:
        found = []
        for px, width in zip(pixels, widths.to_pylist(), strict=True):
            whole = px.is_valid and width and len(px.values) and len(px.values) % width == 0
            found.append(perceptual_hash(np.asarray(px.values, np.float64), width) if whole else None)
        yield pa.array(found, pa.int64())


def page_fingerprint(px: Column, width: Column) -> Column:
    """A perceptual fingerprint of a grey image, its pixels row by row: copies that are scaled, brightened or compressed
    anew have the same or nearly the same. Null for images without pixels or of uneven rows."""
    return F.arrow_udf(_hashes, "long", functionType=F.ArrowUDFType.SCALAR_ITER)(px, width)


def canonical_pages(pages: DataFrame, doc: str, page: str, fp: str, bits: int = 0) -> DataFrame:
    """pages with canonical_page, the lowest page of the document whose fingerprint differs in at most `bits` bits.

    With no bits to spare pages meet by the fingerprint; else by one of bits + 1 bands of it, one of which two such
    fingerprints have in common. Pages without a fingerprint are their own.
    """
    lowest = pages.where(F.col(fp).isNotNull()).groupBy(doc, fp).agg(F.min(page).alias("canonical_page"))
    if bits:
        edges = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
        masks = [int.from_bytes(((1 << b) - (1 << a)).to_bytes(8, "big"), "big", signed=True) for a, b in zip(edges, edges[1:], strict=False)]
        band = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(fp).bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks)]))
        banded = lowest.withColumn("b", band).select(doc, fp, "canonical_page", "b.*")
        others = banded.select(doc, "band", "value", F.col(fp).alias("_fp"), F.col("canonical_page").alias("_page"))
        near = banded.join(others, [doc, "band", "value"]).where(F.bit_count(F.col(fp).bitwiseXOR(F.col("_fp"))) <= bits)
        lowest = near.groupBy(doc, fp).agg(F.min("_page").alias("canonical_page"))
    return pages.join(lowest, [doc, fp], "left").withColumn("canonical_page", F.coalesce("canonical_page", page))
