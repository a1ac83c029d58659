"""Record, image, model and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import images as I
from leafmill.operators import models as M
from leafmill.operators import records as R
from leafmill.operators.sized import dealt
from leafmill.plans.tables import query, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
register = query(QUERIES, ORACLES)


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    """Per customer one chunk for each order: a scalar, a list and a map field, some blank."""
    o = table(spark, d, "orders")
    scalar = F.when(F.col("o_orderkey") % 3 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderpriority"))
    return o.select(
        F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("chunk"), scalar.alias("scalar"),
        F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1), F.lit("")).alias("list"),
        F.create_map(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")), F.lit("all"), F.col("o_orderstatus")).alias("map"),
    )


REC = """r AS (SELECT o_custkey AS record, o_orderkey AS chunk, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS scalar, o_orderstatus AS s, o_orderpriority AS p FROM orders),
 sc AS (SELECT record, arg_max(scalar, chunk) AS value FROM r WHERE scalar IS NOT NULL AND scalar <> 'n/a' GROUP BY 1),
 it AS (SELECT record, item, min((chunk, pos)) AS place FROM (SELECT record, chunk, 0 AS pos, s AS item FROM r UNION ALL SELECT record, chunk, 1, substr(p, 1, 1) FROM r) GROUP BY 1, 2),
 li AS (SELECT record, list(item ORDER BY place) AS value FROM it GROUP BY 1),
 mp AS (SELECT record, name, arg_max(v, chunk) AS value FROM (SELECT record, chunk, s AS name, CASE WHEN chunk % 4 <> 0 THEN p END AS v FROM r UNION ALL SELECT record, chunk, 'all', s FROM r) WHERE v IS NOT NULL GROUP BY 1, 2)"""


@register(f"WITH {REC} SELECT record, value FROM sc")
def consolidate_scalars(spark, d):
    return R.consolidate_scalars(chunk_records(spark, d).withColumn("value", F.col("scalar")), ["record"])


@register(f"WITH {REC} SELECT record, array_to_string(value, ',') AS value FROM li")
def consolidate_lists(spark, d):
    rows = R.consolidate_lists(chunk_records(spark, d).withColumn("value", F.col("list")), ["record"])
    return rows.select("record", F.array_join("value", ",").alias("value"))


@register(f"WITH {REC} SELECT record, name, value FROM mp")
def consolidate_maps(spark, d):
    return R.consolidate_maps(chunk_records(spark, d).withColumn("value", F.col("map")), ["record"])


@register(f"""WITH {REC}, k AS (SELECT record, max(chunk) FILTER (chunk % 7 = 0 AND scalar IS NOT NULL AND scalar <> 'n/a') AS s, max(chunk) FILTER (chunk % 7 = 1) AS m,
 arg_min(CASE WHEN chunk % 7 = 0 THEN 'scalar' WHEN chunk % 7 = 1 THEN 'map' ELSE 'list' END, chunk) FILTER (chunk % 7 <> 0 OR (scalar IS NOT NULL AND scalar <> 'n/a')) AS f FROM r GROUP BY 1)
 SELECT record, CASE WHEN m IS NOT NULL AND (s IS NULL OR m > s) THEN 'map' WHEN s IS NOT NULL THEN 'scalar' ELSE f END AS kind FROM k WHERE f IS NOT NULL""")
def consolidate_mixed(spark, d):
    """Keys whose kind changes from chunk to chunk: which kind survives."""
    n = F.col("chunk") % 7
    rows = chunk_records(spark, d).withColumn("kind", F.when(n == 0, "scalar").when(n == 1, "map").otherwise("list"))
    return R.consolidate(rows, ["record"]).select("record", "kind").distinct()


def fields(spark: SparkSession) -> DataFrame:
    rows = [
        ("Who", 0, "name", "Name", "text", None), ("Who", 1, "segment", "Segment", "text", None), ("State", 2, "score", "Score", "score", None), ("State", 3, "active", "Active", "checkbox", None),
        ("More", 4, "checks", "Checks", "checklist", ["one", "two"]), ("More", 5, "pairs", "Pairs", "checklist_kv", ["a", "b"]), ("More", 6, "rows", "Rows", "table", ["x", "y"]),
    ]
    return spark.createDataFrame(rows, "section string, pos int, name string, label string, type string, items array<string>")


def customer_records(spark: SparkSession, d: str) -> DataFrame:
    c = dealt(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", rows=50_000)  # seven rows are made of each
    k = F.col("c_custkey")
    active = F.when(k % 2 == 0, "checked").otherwise("maybe")
    score = F.when(k % 7 != 0, F.to_json(F.struct((k % 10).cast("string").alias("value"), F.when(k % 10 >= 7, "high").alias("band"))))
    checks = F.when(k % 4 == 0, F.lit('{"one":"unchecked","two":"maybe"}')).otherwise(F.lit('{"three":"checked"}'))
    pairs = F.when(k % 5 == 0, F.lit('{"a":"n/a"}')).otherwise(F.concat(F.lit('{"b":"'), k, F.lit('"}')))
    rows = F.when(k % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"x":"'), k, F.lit('"},{"y":"last"}]')))
    said = {"name": F.col("c_name"), "segment": F.when(k % 3 == 0, "N/A").otherwise(F.col("c_mktsegment")), "score": score, "active": active, "checks": checks, "pairs": pairs, "rows": rows}
    return c.select(k.alias("record"), F.explode(F.create_map(*[x for n, v in said.items() for x in (F.lit(n), v)])).alias("name", "value"))


N_FILLED = "1 + CAST(c_custkey % 3 <> 0 AS INTEGER) * 2 + CAST(c_custkey % 7 <> 0 AS INTEGER) + CAST(c_custkey % 2 = 0 AS INTEGER) + CAST(c_custkey % 4 = 0 AS INTEGER) + CAST(c_custkey % 5 <> 0 AS INTEGER)"


@register(f"SELECT c_custkey AS record, 7 AS total, {N_FILLED} AS filled, 7 - ({N_FILLED}) AS blank FROM customer")
def field_completeness(spark, d):
    return R.completeness(customer_records(spark, d), fields(spark).select("name", "type", "items"), "record")


@register("""WITH s AS (SELECT c_custkey AS k, [
 '## Who' || chr(10) || '- **Name:** ' || c_name || CASE WHEN c_custkey % 3 <> 0 THEN chr(10) || '- **Segment:** ' || c_mktsegment ELSE '' END,
 '## State' || chr(10) || nullif(array_to_string(list_filter([CASE WHEN c_custkey % 7 <> 0 THEN '- **Score:** ' || c_custkey % 10 || CASE WHEN c_custkey % 10 >= 7 THEN ' (high)' ELSE '' END END, CASE WHEN c_custkey % 2 = 0 THEN '- **Active:** ☑' END], lambda x: x IS NOT NULL), chr(10)), ''),
 '## More' || chr(10) || nullif(array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN '- **Checks:**' || chr(10) || '    - ☐ one' END, CASE WHEN c_custkey % 5 <> 0 THEN '- **Pairs:**' || chr(10) || '    - b: ' || c_custkey END,
 CASE WHEN c_custkey % 3 <> 0 THEN '**Rows:**' || chr(10) || '| x | y |' || chr(10) || '|---|---|' || chr(10) || '| ' || c_custkey || ' | — |' || chr(10) || '| — | last |' END], lambda x: x IS NOT NULL), chr(10)), '')] AS parts FROM customer)
 SELECT k AS record, array_to_string(list_filter(parts, lambda x: x IS NOT NULL), chr(10) || chr(10)) AS markdown FROM s""")
def render_record(spark, d):
    return R.render(customer_records(spark, d), fields(spark), "record")


@register("""WITH e AS (SELECT DISTINCT o_custkey AS record, CASE WHEN o_orderkey % 6 = 0 THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderstatus AS event FROM orders WHERE o_orderkey % 5 <> 0),
 s AS (SELECT *, date = 'later' AS late FROM e)
 SELECT record, string_agg('- ' || date || CASE WHEN late THEN ' (unknown)' ELSE '' END || ': ' || event, chr(10) ORDER BY late, date, event) AS timeline FROM s GROUP BY 1""")
def timeline(spark, d):
    o = table(spark, d, "orders")
    date = F.when(F.col("o_orderkey") % 5 == 0, " ").when(F.col("o_orderkey") % 6 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.timeline(o.select(F.col("o_custkey").alias("record"), date.alias("date"), F.col("o_orderstatus").alias("event")), "record")


@register("""SELECT o_orderkey AS id, i AS reading_order, CASE i WHEN 0 THEN 'pred_0' ELSE 'r' || o_orderkey END AS region_id, CASE i WHEN 0 THEN 'ITEM' ELSE 'Table' END AS region_type, CASE i WHEN 0 THEN 0 ELSE 3 END AS page_number,
 CASE i WHEN 0 THEN 0 ELSE 4 END AS n_bbox, CASE i WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS text_content, CASE i WHEN 0 THEN 'ITEM' END AS entity_classification, CASE i WHEN 0 THEN 'A' ELSE 'B' END AS resolved_name,
 CASE i WHEN 0 THEN NULL ELSE 'sheet' END AS dataset_source, CASE i WHEN 0 THEN round((o_orderkey % 100) / 100.0::DOUBLE, 2) ELSE 0.0 END AS confidence_score, CASE i WHEN 0 THEN round((o_orderkey % 100) / 100.0::DOUBLE, 2) ELSE 0.0 END AS resolution_confidence,
 CASE i WHEN 0 THEN 0.0::DOUBLE ELSE 0.5 END AS ocr_confidence, CASE i WHEN 0 THEN 'unknown' ELSE 'm1' END AS ocr_model_used FROM orders, range(2) r(i)""")
def sc_19_predictions(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat(
        F.lit('[{"Original Text":"'), "o_orderstatus", F.lit('","Predicted Code":"A","Predicted Name":"","Type":"ITEM","Confidence":"'), F.round(F.col("o_orderkey") % 100 / 100, 2).cast("string"),
        F.lit('"},{"text":"'), "o_orderpriority", F.lit('","code":"B","Confidence":"high","region_id":"r'), "o_orderkey",
        F.lit('","region_type":"Table","page":3,"bbox":[1,2,3,4],"dataset_source":"sheet","ocr_confidence":0.5,"ocr_model_used":"m1"}]'),
    )
    rows = R.predictions(o.select(F.col("o_orderkey").alias("id"), raw.alias("raw")), "id", "raw")
    return rows.withColumn("n_bbox", F.size("bbox")).drop("bbox")


@register("""SELECT c_custkey AS id, 'Customer ' || c_mktsegment[1:1] AS name, CASE WHEN c_custkey % 2 = 0 THEN 'IP' || c_custkey ELSE '—' END AS ip_no, 'Dr. John Smith' AS doctor, CASE WHEN c_custkey % 3 = 0 THEN 'Ann Lee' ELSE '—' END AS nurse FROM customer""")
def sc_14_patient_meta(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    parts = [F.concat(F.lit("**Name:** CUSTOMER "), F.substring("c_mktsegment", 1, 1), F.lit(" 7")), F.lit("Treating Doctor: dr. JOHN smith 1"), F.when(k % 2 == 0, F.concat(F.lit("IP No: IP"), k)), F.when(k % 3 == 0, F.lit("**Staff:** ann lee 2"))]
    text = F.concat_ws("\n", *parts)
    return c.select(k.alias("id"), *R.patient_meta(text))


@register("""SELECT c_custkey AS id, 1 AS rule_id, 'high' AS severity FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL
 SELECT c_custkey, 2, 'low' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, 3, 'mid' FROM customer WHERE c_custkey % 90 >= 65""")
def rule_alerts(spark, d):
    c = table(spark, d, "customer")
    facts = c.select(F.col("c_custkey").alias("id"), F.explode(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("field", "value"))
    rules = spark.createDataFrame([(1, ["segment"], ["BUILDING", "3"], None, "high"), (2, [], ["3"], None, "low"), (3, [], ["none"], 65, "mid")], "rule_id int, fields array<string>, values array<string>, age_threshold int, severity string")
    return R.rule_alerts(facts, c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 90).alias("age")), rules, "id")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127).cast("int")).alias("px"))


PX = "px AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 127) AS INTEGER)) AS px FROM embeddings), u AS (SELECT vec_id, unnest(px) AS p FROM px)"


@register(f"""WITH {PX}, m AS (SELECT vec_id, quantile_cont(p, 0.5) AS m FROM u GROUP BY 1)
 SELECT u.vec_id, round(avg(CASE WHEN p < m - 30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ink, round(avg(CASE WHEN p < m - 30 THEN 1.0::DOUBLE ELSE 0 END), 6) < 0.01 AS is_blank FROM u JOIN m ON m.vec_id = u.vec_id GROUP BY 1""")
def blank_pages(spark, d):
    return I.blank_pages(pixels(spark, d)).select("vec_id", "ink", "is_blank")


@register(f"""WITH {PX}, m AS (SELECT vec_id, quantile_cont(p, 0.02) AS a, quantile_cont(p, 0.98) AS b FROM u GROUP BY 1)
 SELECT u.vec_id, round(sum(greatest(0, least(255, (p - a) * 255.0::DOUBLE / greatest(b - a, 1)))), 3) AS total FROM u JOIN m ON m.vec_id = u.vec_id GROUP BY 1""")
def contrast_stretch(spark, d):
    return pixels(spark, d).select("vec_id", F.round(F.aggregate(I.stretch(F.col("px")), F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@register(f"""WITH {PX}, s AS (SELECT vec_id, r, list_sum(px[r * 8 + 1:r * 8 + 8]) AS t FROM px, range(8) q(r)) SELECT vec_id, round(var_pop(t), 6) AS variance FROM s GROUP BY 1""")
def projection_variance(spark, d):
    return pixels(spark, d).select("vec_id", F.round(I.projection_variance(F.col("px"), 8, 8), 6).alias("variance"))


@register("""WITH r AS (SELECT l_orderkey AS page, l_linenumber AS c, max(l_discount * 10) AS s FROM lineitem GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s DESC, c) AS n, lead(s) OVER (PARTITION BY page ORDER BY s DESC, c) AS nx FROM r)
 SELECT page, CASE WHEN s >= 0.5 AND (nx IS NULL OR s >= 1.3 * nx) THEN c ELSE 0 END AS winner FROM w WHERE n = 1""")
def winner_margin(spark, d):
    scores = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("c")).agg(F.max(F.col("l_discount") * 10).alias("s"))
    return I.winner(scores, "page", "c", "s")


@register("SELECT l_orderkey AS region, round(exp(avg(-l_discount)), 6) AS confidence FROM lineitem GROUP BY 1")
def token_confidence(spark, d):
    return M.token_confidence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("region"), (-F.col("l_discount")).alias("lp")), "region", "lp")


@register("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderpriority ELSE CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END END AS text,
 o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS fallback FROM orders""")
def best_of_two(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    first = o.select(k.alias("id"), F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("text"), F.when(k % 2 == 0, 0.1).otherwise(0.9).alias("conf"), F.when(k % 3 == 0, 50).otherwise(10).alias("area"), F.lit(100).alias("page_area"))
    second = o.where(k % 5 != 0).select(k.alias("id"), F.col("o_orderpriority").alias("text"), F.lit(0.6).alias("conf"))
    return M.best_of_two(first, second, "id").select("id", "text", "fallback")


@register("SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' is ' || CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'not open: ' || o_orderstatus END AS prompt FROM orders")
def prompt_rows(spark, d):
    templates = spark.createDataFrame([("O", "Order {id} is open"), ("F", "Order {id} is not open: {kind}"), ("P", "Order {id} is not open: {kind}")], "kind string, template string")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return M.prompts(rows, templates, "kind").select("id", "prompt")


@register("SELECT p_partkey, 1.0 AS norm FROM part")
def hashed_embeddings(spark, d):
    """Unit vectors of part names."""
    v = M.hashed_embedding(table(spark, d, "part"), "p_partkey", "p_name")
    return v.select("p_partkey", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@register("""SELECT vec_id, unnest([0, 1, 2, 3, 4]) AS page_no, unnest([0, 0, 0, 3, 3]) AS canonical_page FROM embeddings""")
def perceptual_pages(spark, d):
    """An image, its copies of twice the size and of other brightness and contrast, its negative and a copy of that."""
    px = pixels(spark, d)
    twice = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.flatten(F.transform(F.slice("px", F.floor(r / 2).cast("int") * 8 + 1, F.lit(8)), lambda p: F.array(p, p)))))
    changed = lambda f: F.transform("px", f)
    made = [F.col("px"), twice, changed(lambda p: p * 0.9 + 20), changed(lambda p: 255 - p), changed(lambda p: 265 - p)]
    images = F.array(*[F.struct(F.lit(k).alias("page_no"), F.transform(x, lambda p: p.cast("double")).alias("px"), F.lit(16 if k == 1 else 8).alias("width")) for k, x in enumerate(made)])
    pages = px.select("vec_id", F.inline(images)).select("vec_id", "page_no", I.page_fingerprint(F.col("px"), F.col("width")).alias("fp"))
    return I.canonical_pages(pages, "vec_id", "page_no", "fp").select("vec_id", "page_no", "canonical_page")
