"""Entity resolution queries: parts, suppliers and event types are the catalogs, line items name the codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import entities as E
from leafmill.operators.sized import dealt, if_small
from leafmill.plans.markdown import spelled
from leafmill.plans.tables import query, table
from leafmill.sources import catalogs as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
register = query(QUERIES, ORACLES)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Three sheets of different shapes under one key, missing columns null, blank and `nan` codes dropped."""
    p = table(spark, d, "part")
    odd = F.when(F.col("p_partkey") % 50 == 0, " ").when(F.col("p_partkey") % 50 == 1, "NaN")
    item = p.select(F.lit("ITEM").alias("TYPE"), F.concat(F.lit("ITEM"), "p_partkey").alias("CODE"), F.concat_ws(" ", "p_name", "p_brand").alias("NAME"))
    item = item.unionByName(p.where(odd.isNotNull()).select(F.lit("ITEM").alias("TYPE"), odd.alias("CODE"), F.col("p_name").alias("NAME")))
    service = table(spark, d, "supplier").select(F.lit("SERVICE").alias("TYPE"), F.concat(F.lit("SVC"), "s_suppkey").alias("CODE"), F.col("s_name").alias("NAME"))
    frequency = table(spark, d, "events").select("event_type").distinct().select(F.lit("FREQUENCY").alias("TYPE"), F.col("event_type").alias("CODE"), F.concat(F.lit("on "), "event_type").alias("MEANING"))
    rows = S.union_sheets({"items": item, "services": service, "frequencies": frequency}, "CODE")
    return rows.where(~X.is_blank(F.col("CODE"))).withColumn("KEY", F.concat_ws("|", "TYPE", "CODE"))


@register("""SELECT 'ITEM|ITEM' || p_partkey AS "KEY", 'ITEM' AS "TYPE", 'ITEM' || p_partkey AS "CODE", p_name || ' ' || p_brand AS "NAME", 'items' AS "SHEET", NULL AS "MEANING" FROM part
 UNION ALL SELECT 'SERVICE|SVC' || s_suppkey, 'SERVICE', 'SVC' || s_suppkey, s_name, 'services', NULL FROM supplier
 UNION ALL SELECT DISTINCT 'FREQUENCY|' || event_type, 'FREQUENCY', event_type, NULL, 'frequencies', 'on ' || event_type FROM events""")
def unified_catalog(spark, d):
    return catalog(spark, d).select("KEY", "TYPE", "CODE", "NAME", "SHEET", "MEANING")


@register("SELECT p_brand AS code, max(p_partkey) AS pos, arg_max(p_name, p_partkey) AS name FROM part GROUP BY 1")
def catalog_last_wins(spark, d):
    return E.last_wins(table(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name")), "code", "pos")


@register("SELECT l_orderkey AS id, CASE WHEN p_partkey IS NULL THEN NULL ELSE 'ITEM' || p_partkey END AS code, CASE WHEN p_partkey IS NULL THEN NULL WHEN l_linenumber % 4 = 0 THEN 'exact' ELSE 'compact' END AS tier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def resolve_codes(spark, d):
    tokens = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), spelled(F.col("l_partkey"), F.col("l_linenumber")).alias("token"))
    codes = table(spark, d, "part").select(F.concat(F.lit("ITEM"), "p_partkey").alias("code"))
    return E.resolve_codes(tokens, codes).select("id", "code", "tier")


TYPES = "(SELECT DISTINCT p_type AS code FROM part)"


@register(f"""WITH t AS (SELECT p_partkey AS id, lower(CASE WHEN p_partkey % 2 = 0 THEN 'xx ' || p_type || ' yy' ELSE substr(p_type, 1, 4) END) AS t FROM part),
 m AS (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY length(code) DESC, code) AS r FROM t JOIN {TYPES} ON contains(t, lower(code)) OR contains(lower(code), t))
 SELECT id, code FROM m WHERE r = 1""")
def containment_match(spark, d):
    p = table(spark, d, "part")
    token = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("xx "), "p_type", F.lit(" yy"))).otherwise(F.substring("p_type", 1, 4))
    return E.containment(p.select(F.col("p_partkey").alias("id"), token.alias("token")), p.select(F.col("p_type").alias("code")).distinct())


@register()
def fuzzy_match(spark, d):
    """Names with a dropped letter find their type again."""
    p = table(spark, d, "part")
    token = F.concat(F.substring("p_type", 1, 2), F.expr("substring(p_type, 4)"))
    return E.fuzzy(p.select(F.col("p_partkey").alias("id"), token.alias("token")), p.select(F.col("p_type").alias("code")).distinct())


GRAMS = "unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length({0}) - n + 2), lambda i: substr({0}, i, n)))))"
WEIGHTS = f"""tf AS (SELECT cat_id, g AS gram, count(*) AS tf FROM (SELECT cat_id, {GRAMS.format("lower(name)")} AS g FROM cat) GROUP BY 1, 2),
 df AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM cat)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1),
 cw AS (SELECT cat_id, tf.gram, tf * idf AS w FROM tf JOIN df ON df.gram = tf.gram),
 cn AS (SELECT cat_id, sqrt(sum(w * w)) AS n FROM cw GROUP BY 1)"""
FIT = f"cat AS (SELECT DISTINCT p_name AS cat_id, p_name AS name FROM part), {WEIGHTS}"


def names(spark: SparkSession, d: str) -> DataFrame:
    """(cat_id, name): distinct names, which are their own keys."""
    return table(spark, d, "part").select(F.col("p_name").alias("cat_id"), F.col("p_name").alias("name")).distinct()


@register(f"WITH {FIT} SELECT gram, df, round(idf, 6) AS idf FROM df")
def tfidf_fit(spark, d):
    return E.tfidf_fit(names(spark, d))[0].select("gram", "df", F.round("idf", 6).alias("idf"))


@register(f"""WITH {FIT}, t AS (SELECT DISTINCT replace(p_name, 'e', 'a') AS token FROM part),
 qf AS (SELECT token, g AS gram, count(*) AS tf FROM (SELECT token, {GRAMS.format("lower(token)")} AS g FROM t) GROUP BY 1, 2),
 qw AS (SELECT token, qf.gram, tf * idf AS w FROM qf JOIN df ON df.gram = qf.gram), qn AS (SELECT token, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
 dots AS (SELECT token, qw.w * cw.w AS x, cat_id FROM qw JOIN cw ON cw.gram = qw.gram),
 s AS (SELECT dots.token, dots.cat_id, round(sum(x) / (any_value(qn.n) * any_value(cn.n)), 6) AS score FROM dots JOIN qn ON qn.token = dots.token JOIN cn ON cn.cat_id = dots.cat_id GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, cat_id) AS r FROM s)
 SELECT p_partkey AS id, cat_id, score FROM part JOIN b ON replace(p_name, 'e', 'a') = token WHERE r = 1 AND score > 0.55""")
def tfidf_nn(spark, d):
    tokens = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", "e", "a").alias("token"))
    return E.tfidf_nearest(tokens, *E.tfidf_fit(names(spark, d)))


TOKENS = "(SELECT doc_id, i AS pos, w[i] AS token FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents))"


PREFIXES = ", ".join(f"'{p}'" for p in X.NOT_ENTITIES)
CANDIDATE = f"""CASE WHEN known THEN true WHEN length(t) < 2 THEN false WHEN list_bool_or(list_transform([{PREFIXES}], lambda p: starts_with(lower(t), p))) THEN false
 WHEN regexp_matches(t, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') THEN false WHEN regexp_matches(t, '(?i)^\\d{{1,2}}\\s*(am|pm)$') THEN false
 WHEN regexp_matches(t, '^\\d{{1,2}}:\\d{{2}}') THEN false WHEN regexp_matches(t, '(?i)^\\d+\\s+[a-z]+$') THEN false
 WHEN regexp_matches(t, '(?i)^\\d+([./]\\d+)?[a-z]{{0,3}}$') AND NOT regexp_matches(t, '[A-Z]{{2,}}') THEN false WHEN regexp_matches(t, '\\d') THEN true
 ELSE length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 0.8 * greatest(1, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))) AND length(t) BETWEEN 2 AND 12 END"""


@register(f"""WITH k AS (SELECT DISTINCT upper(event_type) AS code FROM events UNION SELECT 'THE'),
 t AS (SELECT doc_id, trim(token) AS t, upper(trim(token)) IN (SELECT code FROM k) AS known FROM {TOKENS})
 SELECT doc_id, count(*) AS n_tokens, count(*) FILTER ({CANDIDATE}) AS n_candidates, count(*) FILTER (known) AS n_known FROM t GROUP BY 1""")
def entity_candidates(spark, d):
    """Tokens of documents that may be entities; event types and one word are the known codes."""
    codes = table(spark, d, "events").select(F.upper("event_type").alias("code")).union(spark.range(1).select(F.lit("THE"))).distinct()
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token")).withColumn("code", F.upper(F.trim("token")))
    met = tokens.join(if_small(codes.withColumn("_met", F.lit(True))), "code", "left").withColumn("known", F.coalesce("_met", F.lit(False)))
    return met.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(X.entity_candidate(F.col("token"), F.col("known"))).alias("n_candidates"), F.count_if("known").alias("n_known"))


def prescriptions(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): a table with a code, a header line, a code and a name with a dose in bulleted lines."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    rows = ["| S.No | Test Code/Name |", "|---|---|", F.concat(F.lit("| "), "id", F.lit(" | item"), "id", F.lit(" |")), "Name: ITEM1", F.concat(F.lit("- ITEM"), F.col("id") + 1), "plain words", "DATE 2020", F.concat(F.lit("- "), "p_name", F.lit(" 5x"))]
    return p.select("id", F.array_join(F.array(*[F.lit(r) if isinstance(r, str) else r for r in rows]), "\n").alias("text"))


def items(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("cat_id"), F.concat(F.lit("ITEM"), "p_partkey").alias("code"), F.lit("ITEM").alias("type"), F.col("p_name").alias("name"), none.alias("meaning"), none.alias("timing"))


@register(f"""WITH c AS (SELECT p_partkey AS id, unnest([2, 4]) AS line_no FROM part), f AS (SELECT id, line_no, CASE line_no WHEN 2 THEN id ELSE id + 1 END AS k FROM c),
 cat AS (SELECT p_partkey AS cat_id, p_name AS name FROM part), {WEIGHTS},
 t AS (SELECT DISTINCT p_name || ' 5x' AS token FROM part),
 qf AS (SELECT token, g AS gram, count(*) AS tf FROM (SELECT token, {GRAMS.format("lower(token)")} AS g FROM t) GROUP BY 1, 2),
 qw AS (SELECT token, qf.gram, tf * idf AS w FROM qf JOIN df ON df.gram = qf.gram), qn AS (SELECT token, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
 s AS (SELECT qw.token, cw.cat_id, round(sum(qw.w * cw.w) / (any_value(qn.n) * any_value(cn.n)), 6) AS score FROM qw JOIN cw ON cw.gram = qw.gram JOIN qn ON qn.token = qw.token JOIN cn ON cn.cat_id = cw.cat_id GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, cat_id) AS r FROM s)
 SELECT id, line_no, CASE line_no WHEN 2 THEN 2 ELSE 0 END AS cell_no, CASE line_no WHEN 2 THEN 'item' ELSE 'ITEM' END || k AS text, 'ITEM' || k AS code, p_name AS name, 'ITEM' AS type, '1.00' AS confidence FROM f JOIN part ON p_partkey = k
 UNION ALL SELECT q.p_partkey, 7, 0, token, 'ITEM' || cat_id, n.p_name, 'ITEM', printf('%.2f', score) FROM part q JOIN b ON token = q.p_name || ' 5x' JOIN part n ON n.p_partkey = cat_id WHERE r = 1 AND score > 0.55""")
def entity_predictions(spark, d):
    """Entities in lines and table cells by exact code and by the nearest name; labels, counts and prose are left alone."""
    rows = E.resolve_entities(prescriptions(spark, d), items(spark, d), "id")[0]
    return rows.select("id", "line_no", "cell_no", "text", "code", "name", "type", "confidence")


@register("""SELECT p_partkey AS id, unnest([0, 1]) AS pos, unnest(['view - ' || (p_partkey % 10), 'Click ' || (p_partkey % 7)]) AS raw FROM part""")
def code_mentions(spark, d):
    """Codes of a dictionary in running text, however blanks and dashes are set; not inside words."""
    p = dealt(table(spark, d, "part").select("p_partkey"), "p_partkey")
    text = F.concat(F.lit("took view - "), F.col("p_partkey") % 10, F.lit(", preview-1x or (Click "), F.col("p_partkey") % 7, F.lit(") daily"))
    codes = [f"view-{i}" for i in range(10)] + [f"click {i}" for i in range(7)]
    return E.code_mentions(p.select(F.col("p_partkey").alias("id"), text.alias("text")), "id", codes)


@register("""SELECT p_partkey AS id, unnest([0, 1]) AS pos, 'Freq' AS code, unnest(['every ' || (p_partkey % 10) || ' hours; Instr → with water', 'every 3 hours; Instr → with water']) AS meaning FROM part""")
def annotations_back(spark, d):
    """Annotated mentions, and the table of annotations read back from the text."""
    p = dealt(table(spark, d, "part").select("p_partkey"), "p_partkey")
    codes = [f"Q{i}H" for i in range(10)]
    catalog = spark.range(10).select(F.concat(F.lit("Q"), "id", F.lit("H")).alias("code"), F.concat(F.lit("every "), "id", F.lit(" hours")).alias("meaning"), F.lit("with water").alias("instruction"))
    docs = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("take q"), F.col("p_partkey") % 10, F.lit("h, then Q3H [note] or Q33H")).alias("text"))
    return E.annotations(E.annotate_codes(docs, catalog, "id", codes), "id")


@register("""SELECT p_partkey AS id, 'buy ' || CASE WHEN p_partkey % 3 = 0 THEN '$' || p_brand || '\\1!' ELSE p_type END || ' now' AS text, CAST(least(p_partkey % 3, 1) AS BIGINT) AS n_suggested, CAST(p_partkey % 3 // 2 AS BIGINT) AS n_uncertain FROM part""")
def corrections_applied(spark, d):
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    docs = p.select("id", F.concat(F.lit("buy "), "p_type", F.lit(" now")).alias("text"))
    made = p.select("id", F.lit(0).alias("pos"), F.lower("p_type").alias("wrong"), F.concat(F.lit("$"), "p_brand", F.lit("\\1!")).alias("right"), F.element_at(F.array(F.lit(0.95), F.lit(0.87), F.lit(0.5)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("confidence"))
    return E.apply_corrections(docs, made, "id")


@register("""SELECT p_partkey AS id, unnest(list_distinct(['Code' || p_partkey, 'code' || p_partkey, 'CODE' || p_partkey, 'Code ' || p_partkey, 'Code-' || p_partkey, replace('Code' || p_partkey, '1', 'I'),
 replace('Code' || p_partkey, '1', 'l'), 'Code' || p_partkey || ' x 5 days', 'after meals Code' || p_partkey])) AS variant FROM part""")
def noise_variants(spark, d):
    return E.noise_variants(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Code"), "p_partkey").alias("code")), "id", "code")
