"""Page layout: overlaps, bands, reading order, line bins, greedy merging and coverage of boxes.

Boxes are rows (page, region, x1, y1, x2, y2); every join carries the page as an equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.operators.sized import shuffled

WIDE, GAP, OVERLAP, COVER = 0.6, 0.03, 0.3, 0.4


def area(p: str = "") -> Column:
    c = lambda n: F.col(f"{p}{n}")
    return F.greatest(F.lit(0), c("x2") - c("x1")) * F.greatest(F.lit(0), c("y2") - c("y1"))


def overlap_pairs(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """(page, a, b, ratio, iou): pairs whose overlap exceeds `threshold` of the smaller box."""
    a, b = boxes.alias("a"), boxes.alias("b")
    both = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.region") < F.col("b.region")))
    w = F.greatest(F.lit(0), F.least("a.x2", "b.x2") - F.greatest("a.x1", "b.x1"))
    h = F.greatest(F.lit(0), F.least("a.y2", "b.y2") - F.greatest("a.y1", "b.y1"))
    shared = w * h
    smaller = F.least(area("a."), area("b."))
    rows = both.select(
        F.col("a.page").alias("page"), F.col("a.region").alias("a"), F.col("b.region").alias("b"),
        F.when(smaller > 0, shared / smaller).otherwise(0.0).alias("ratio"),
        F.when(area("a.") + area("b.") - shared > 0, shared / (area("a.") + area("b.") - shared)).otherwise(0.0).alias("iou"),
    )
    return rows.where(F.col("ratio") > threshold)


def bands(boxes: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """(page, band, y_start, y_end): the page cut at the tops and bottoms of wide boxes. A page is gathered once, its edges alone."""
    wide = F.col("x2") - F.col("x1") >= WIDE * page_width
    edges = boxes.groupBy("page").agg(F.flatten(F.collect_list(F.when(wide, F.array("y1", "y2")))).alias("e"))
    cuts = edges.select("page", F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.lit(0), F.lit(page_height)).cast(edges.schema["e"].dataType), "e")))).alias("y"))
    n = F.size("y") - 1
    pairs = F.zip_with(F.slice("y", F.lit(1), n), F.slice("y", F.lit(2), n), lambda a, b: F.struct(a.alias("y_start"), b.alias("y_end")))
    return cuts.select("page", F.posexplode(pairs).alias("band", "b")).select("page", "band", "b.y_start", "b.y_end")


def region_bands(boxes: DataFrame, cut: DataFrame) -> DataFrame:
    """boxes with the first band that holds their centre, band 0 if none does. A box meets the bands of its page as one row."""
    centre = (F.col("y1") + F.col("y2")) / 2
    lists = cut.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("band", "y_start", "y_end"))).alias("_bands"))
    met = F.filter("_bands", lambda b: (centre >= b["y_start"]) & (centre <= b["y_end"]))
    return boxes.join(shuffled(lists), "page", "left").withColumn("band", F.coalesce(F.get(met, F.lit(0))["band"], F.lit(0))).drop("_bands")


def reading_order(boxes: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """(page, region, position): bands from the top; in a band wide boxes, then columns, then y.

    A wide box owns the band that its own edges bound; a new column starts where a gap wider than GAP of
    the page follows the right edge of the box before.
    """
    cut = bands(boxes, page_width, page_height)
    wide = F.col("x2") - F.col("x1") >= WIDE * page_width
    spanning = boxes.where(wide).join(cut, "page").where((F.abs(F.col("y1") - F.col("y_start")) <= 1) & (F.abs(F.col("y2") - F.col("y_end")) <= 1))
    owned = boxes.where(wide).join(spanning.groupBy("page", "region").agg(F.min("band").alias("band")), ["page", "region"], "left")
    heads = owned.withColumn("band", F.coalesce("band", F.lit(0))).withColumn("column", F.lit(-1))
    by_x = Window.partitionBy("page", "band").orderBy("x1", "region")
    regular = region_bands(boxes.where(~wide), cut)
    fresh = F.coalesce(F.col("x1") - F.lag("x2").over(by_x) > GAP * page_width, F.lit(False)).cast("int")
    regular = regular.withColumn("fresh", fresh).withColumn("column", F.sum("fresh").over(by_x))
    cols = ["page", "region", "x1", "y1", "band", F.col("column").cast("long").alias("column")]
    order = Window.partitionBy("page").orderBy("band", "column", "y1", "x1", "region")
    return heads.select(*cols).unionByName(regular.select(*cols)).select("page", "region", F.row_number().over(order).alias("position"))


def line_bins(boxes: DataFrame, height: int = 20) -> DataFrame:
    """(page, region, position): by line of `height`, then from left to right."""
    w = Window.partitionBy("page").orderBy(F.floor(F.col("y1") / height), "x1", "region")
    return boxes.select("page", "region", F.row_number().over(w).alias("position"))


def _merge_page(rows: list[dict]) -> list[dict]:
    """Greedy merging: each box that is left goes once over those after it and grows by what it overlaps enough."""
    out, left = [], rows
    while left:
        head, rest, left = left[0], left[1:], []
        for other in rest:
            w = min(head["x2"], other["x2"]) - max(head["x1"], other["x1"])
            h = min(head["y2"], other["y2"]) - max(head["y1"], other["y1"])
            small = min((r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) for r in (head, other))
            if w > 0 and h > 0 and small > 0 and w * h / small > OVERLAP:
                kind = other["kind"] if head["kind"] == "Paragraph" else head["kind"]
                low = {c: min(head[c], other[c]) for c in ("x1", "y1")}
                high = {c: max(head[c], other[c]) for c in ("x2", "y2")}
                head = head | low | high | {"kind": kind}
            else:
                left.append(other)
        out.append(head)
    return out


def _merge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        boxes = batch.column("boxes")
        yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array([_merge_page(b) for b in boxes.to_pylist()], boxes.type)], names=["page", "boxes"])


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """Overlapping boxes (with a kind) merged page by page, in order of region; pages are gathered by Spark."""
    box = F.struct("region", "kind", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])
    pages = boxes.groupBy("page").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return pages.mapInArrow(_merge_pages, pages.schema).select("page", F.inline("boxes"))


def coverage(boxes: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """(page, covered, whole_page): pages that boxes cover too little are one region."""
    total = float(page_width * page_height)
    sums = boxes.groupBy("page").agg(F.round(F.sum(area()) / total, 6).alias("covered"))
    return sums.withColumn("whole_page", F.col("covered") < COVER)


def pad(x1: Column, y1: Column, x2: Column, y2: Column, by: int, width: int, height: int) -> list[Column]:
    """A box grown on all sides and clamped to its page."""
    return [F.greatest(F.lit(0), x1 - by), F.greatest(F.lit(0), y1 - by), F.least(F.lit(width), x2 + by), F.least(F.lit(height), y2 + by)]
