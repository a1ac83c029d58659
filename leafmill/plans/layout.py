"""Layout queries: each order is a page of 1000 x 1000, its line items are boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators.sized import dealt
from leafmill.plans.tables import query, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
register = query(QUERIES, ORACLES)
SIDE = 1000


def boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    li = lines.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("region")).agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("long").alias("q")
    )
    wide = F.col("region") % 5 == 0
    x1 = F.when(wide, F.lit(50)).otherwise((F.col("p") * 37) % 700)
    y1 = (F.col("s") * 53 + F.col("region") * 91) % 900
    w = F.when(wide, F.lit(800)).otherwise(100 + (F.col("q") * 5) % 200)
    rows = li.select("page", "region", x1.cast("long").alias("x1"), y1.cast("long").alias("y1"), w.alias("w"), (20 + F.col("q") % 60).alias("h"))
    return rows.select("page", "region", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))


BOX = """b AS (SELECT page, region, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (SELECT page, region, CAST(CASE WHEN region % 5 = 0 THEN 50 ELSE (p * 37) % 700 END AS BIGINT) AS x1,
 (s * 53 + region * 91) % 900 AS y1, CASE WHEN region % 5 = 0 THEN 800 ELSE 100 + (q * 5) % 200 END AS w, 20 + q % 60 AS h
 FROM (SELECT l_orderkey AS page, l_linenumber AS region, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)))"""
AREA = "((x2 - x1) * (y2 - y1))"
BANDS = f"""{BOX}, e AS (SELECT page, unnest([y1, y2]) AS y FROM b WHERE x2 - x1 >= 600 UNION SELECT DISTINCT page, unnest([0, 1000]) FROM b),
 c AS (SELECT page, y AS y_start, lead(y) OVER (PARTITION BY page ORDER BY y) AS y_end FROM e),
 bands AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY y_start) - 1 AS band, y_start, y_end FROM c WHERE y_end > y_start),
 rb AS (SELECT b.*, coalesce((SELECT min(band) FROM bands k WHERE k.page = b.page AND (b.y1 + b.y2) / 2.0 BETWEEN y_start AND y_end), 0) AS band FROM b)"""


@register(f"""WITH {BOX}, j AS (SELECT a.page, a.region AS a, b.region AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS s1, (b.x2 - b.x1) * (b.y2 - b.y1) AS s2 FROM b a JOIN b ON a.page = b.page AND a.region < b.region)
 SELECT page, a, b, round(o / least(s1, s2)::DOUBLE, 6) AS ratio, round(o / (s1 + s2 - o)::DOUBLE, 6) AS iou FROM j WHERE o / least(s1, s2)::DOUBLE > 0.3""")
def box_overlap_pairs(spark, d):
    return L.overlap_pairs(boxes(spark, d)).select("page", "a", "b", F.round("ratio", 6).alias("ratio"), F.round("iou", 6).alias("iou"))


@register(f"WITH {BANDS} SELECT page, region, band FROM rb")
def region_band(spark, d):
    b = boxes(spark, d)
    return L.region_bands(b, L.bands(b, SIDE, SIDE)).select("page", "region", "band")


@register(f"""WITH {BANDS},
 sp AS (SELECT b.page, b.region, b.x1, b.y1, coalesce((SELECT min(band) FROM bands k WHERE k.page = b.page AND abs(b.y1 - y_start) <= 1 AND abs(b.y2 - y_end) <= 1), 0) AS band, -1 AS col FROM b WHERE x2 - x1 >= 600),
 rg AS (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page, band ORDER BY x1, region) > 30 THEN 1 ELSE 0 END AS f FROM rb WHERE x2 - x1 < 600),
 rc AS (SELECT page, region, x1, y1, band, sum(f) OVER (PARTITION BY page, band ORDER BY x1, region) AS col FROM rg),
 al AS (SELECT * FROM sp UNION ALL SELECT * FROM rc)
 SELECT page, region, row_number() OVER (PARTITION BY page ORDER BY band, col, y1, x1, region) AS position FROM al""")
def reading_order(spark, d):
    return L.reading_order(boxes(spark, d), SIDE, SIDE)


@register(f"WITH {BOX} SELECT page, region, row_number() OVER (PARTITION BY page ORDER BY y1 // 20, x1, region) AS position FROM b")
def line_bin_order(spark, d):
    return L.line_bins(boxes(spark, d))


@register(f"WITH {BOX} SELECT page, round(sum({AREA}) / 1000000.0::DOUBLE, 6) AS covered, round(sum({AREA}) / 1000000.0::DOUBLE, 6) < 0.4 AS whole_page FROM b GROUP BY 1")
def page_coverage(spark, d):
    return L.coverage(boxes(spark, d), SIDE, SIDE)


MERGED = f"""{BOX}, l AS (SELECT page, list({{'region': region, 'kind': CASE WHEN region % 3 = 0 THEN 'Table' ELSE 'Paragraph' END, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY region) AS bx FROM b GROUP BY 1),
 s AS (SELECT page, bx[1] AS h, bx[2:] AS rest, bx[1:0] AS kept FROM l UNION ALL SELECT page,
 CASE WHEN len(rest) = 0 THEN kept[1] WHEN o THEN {{'region': h.region, 'kind': CASE WHEN h.kind = 'Paragraph' THEN r.kind ELSE h.kind END, 'x1': least(h.x1, r.x1), 'y1': least(h.y1, r.y1), 'x2': greatest(h.x2, r.x2), 'y2': greatest(h.y2, r.y2)}} ELSE h END,
 CASE WHEN len(rest) = 0 THEN kept[2:] ELSE rest[2:] END, CASE WHEN len(rest) = 0 THEN kept[1:0] WHEN o THEN kept ELSE list_append(kept, r) END
 FROM (SELECT *, greatest(0, least(h.x2, r.x2) - greatest(h.x1, r.x1)) * greatest(0, least(h.y2, r.y2) - greatest(h.y1, r.y1)) / least((h.x2 - h.x1) * (h.y2 - h.y1), (r.x2 - r.x1) * (r.y2 - r.y1))::DOUBLE > 0.3 AS o
 FROM (SELECT *, rest[1] AS r FROM s)) WHERE len(rest) + len(kept) > 0)"""


@register(f"WITH RECURSIVE {MERGED} SELECT page, h.region, h.kind, h.x1, h.y1, h.x2, h.y2 FROM s WHERE len(rest) = 0")
def merge_boxes(spark, d):
    kinds = F.when(F.col("region") % 3 == 0, "Table").otherwise("Paragraph")
    return L.merge_boxes(boxes(spark, d).withColumn("kind", kinds))


@register(f"WITH {BOX} SELECT page, region, greatest(0, x1 - 10) AS x1, greatest(0, y1 - 10) AS y1, least(1000, x2 + 10) AS x2, least(1000, y2 + 10) AS y2, {AREA} < 0.3 * 1000000 AS small FROM b")
def sc_21_box_padding(spark, d):
    b = boxes(spark, d)
    grown = L.pad(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 10, SIDE, SIDE)
    return b.select("page", "region", *[g.alias(n) for g, n in zip(grown, ("x1", "y1", "x2", "y2"), strict=True)], (L.area() < 0.3 * SIDE * SIDE).alias("small"))
