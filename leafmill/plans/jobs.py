"""Job, vault, chat and audit queries over the driver tables (orders are jobs, line items their pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import jobs as J
from leafmill.plans.tables import STATUS_SQL, query, status, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
register = query(QUERIES, ORACLES)


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("doc_id"), status(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("created_at"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_no"), (F.col("l_linestatus") == "F").alias("done"), F.col("l_shipdate").alias("finished_at"))


JOBS = f"(SELECT o_orderkey AS job_id, o_custkey AS user_id, o_custkey AS doc_id, {STATUS_SQL} AS status, o_orderdate AS created_at FROM orders)"


@register("SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src' || (doc_id % 20)")
def owned_rows(spark, d):
    """Identifier and owner must both agree."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    pairs = docs.select("doc_id", F.concat(F.lit("src"), F.col("doc_id") % 20).alias("source"))
    return J.owned_rows(docs, "doc_id", "source", pairs)


@register("SELECT event_id, user_id, event_type AS action, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 200")
def audit_recent(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts")
    return J.newest(J.matching(log, user_id=None, action="error"), "ts", "event_id", 200)


@register(f"SELECT job_id, user_id, status, c_name AS name FROM {JOBS} j LEFT JOIN customer ON c_custkey = doc_id AND c_acctbal > 0 WHERE status IN ('PENDING', 'PROCESSING')")
def active_jobs(spark, d):
    names = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"))
    return J.active_jobs(_jobs(spark, d), names).select("job_id", "user_id", "status", "name")


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '00')")
def vault_search(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return J.vault_search(rows, "c_name", "00", "c_mktsegment", "BUILDING")


@register("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_docs_by_user(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderdate", "c_name")
    return J.newest(rows, "o_orderdate", "o_orderkey", 50)


@register(f"SELECT j.job_id, c_name AS name, l_linenumber AS page_no, max(l_linestatus) AS state FROM {JOBS} j JOIN customer ON c_custkey = doc_id JOIN lineitem ON l_orderkey = job_id WHERE status = 'PROCESSING' GROUP BY ALL")
def job_report(spark, d):
    """Job, document and checkpoint entries, the entries unfolded from a map."""
    jobs = J.matching(_jobs(spark, d), status="PROCESSING")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"))
    entries = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), "l_linenumber").agg(F.max("l_linestatus").alias("state"))
    entries = entries.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "state"))).alias("checkpoint"))
    return jobs.join(c, "doc_id").join(entries, "job_id").select("job_id", "name", F.explode("checkpoint").alias("page_no", "state"))


@register("""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS docs,
 (SELECT count(*) FROM conversations WHERE role = 'user') AS queries, (SELECT coalesce(round(avg(quality) * 100, 1), 0) FROM labels) AS confidence""")
def system_metrics(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    asked = J.matching(table(spark, d, "conversations"), role="user")
    mean = table(spark, d, "labels").agg(F.coalesce(F.round(F.avg("quality") * 100, 1), F.lit(0.0)).alias("confidence"))
    one = n(table(spark, d, "customer"), "users").crossJoin(n(table(spark, d, "orders"), "docs"))  # single rows
    return one.crossJoin(n(asked, "queries")).crossJoin(mean)


@register("""SELECT round((SELECT count(*) FROM orders) * 2 * 0.99 + (SELECT count(*) FROM conversations WHERE role = 'user') * 0.05, 2) AS savings""")
def savings(spark, d):
    return system_metrics(spark, d).select(F.round(F.col("docs") * 2 * 0.99 + F.col("queries") * 0.05, 2).alias("savings"))


@register("SELECT o_custkey AS user_id, count(*) AS chunks, min_by(o_orderpriority, o_orderkey) AS category FROM orders GROUP BY 1")
def kb_documents(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("chunks"), F.min_by("o_orderpriority", "o_orderkey").alias("category"))


@register("SELECT coalesce(nullif(CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END, ''), 'Uncategorized') AS category, count(*) AS n FROM customer GROUP BY 1")
def category_counts(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_mktsegment"))
    category = F.coalesce(F.nullif(raw, F.lit("")), F.lit("Uncategorized"))
    return table(spark, d, "customer").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@register("SELECT l_orderkey AS job_id, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 1) AS progress FROM lineitem GROUP BY 1")
def job_progress(spark, d):
    return J.progress(_pages(spark, d), "job_id", F.col("done"))


@register("WITH last AS (SELECT max(CAST(ts AS DATE)) AS m FROM events) SELECT CAST(m - CAST(k AS INTEGER) AS VARCHAR) AS day, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = m - CAST(k AS INTEGER)) AS n FROM last, range(7) r(k)")
def daily_counts(spark, d):
    return J.daily_counts(table(spark, d, "events"), "ts", 7).withColumn("day", F.col("day").cast("string"))


@register("SELECT l_orderkey AS job_id, sum(CAST(l_quantity AS BIGINT)) AS chunks FROM lineitem GROUP BY 1")
def ingest_totals(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("chunks"))


@register("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part")
def distinct_codes(spark, d):
    return table(spark, d, "part").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"))


@register("""SELECT o_orderkey AS job_id, round(epoch(max(CASE WHEN l_linestatus = 'F' THEN l_shipdate END)) - epoch(any_value(o_orderdate)), 2) AS seconds
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def job_elapsed(spark, d):
    ends = _pages(spark, d).groupBy("job_id").agg(F.max(F.when(F.col("done"), F.col("finished_at"))).alias("completed_at"))
    return _jobs(spark, d).join(ends, "job_id").select("job_id", J.elapsed(F.col("created_at"), F.col("completed_at")).alias("seconds"))


@register("SELECT user_id, job_id, r AS rank FROM (SELECT o_custkey AS user_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def recent_per_user(spark, d):
    return J.newest_per(_jobs(spark, d), "user_id", "created_at", "job_id", 5).select("user_id", "job_id", "rank")


@register("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC, role DESC) AS r FROM conversations) WHERE r <= 6")
def last_turns(spark, d):
    """The last six turns of each session."""
    rows = table(spark, d, "conversations").withColumn("order", F.struct("turn", "text", "role"))
    return J.newest_per(rows, "conv_id", "order", "turn", 6).select("conv_id", "turn", "role", "text")


@register("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey")
def list_users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).orderBy("id")


@register("""WITH e AS (SELECT user_id, ts, event_id, event_type <> 'purchase' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) -
  row_number() OVER (PARTITION BY user_id, event_type <> 'purchase' ORDER BY ts, event_id) AS island FROM events)
 SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM e WHERE hit GROUP BY user_id, island HAVING count(*) >= 5""")
def error_streaks(spark, d):
    """Runs of five or more events without a success (a purchase)."""
    return J.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase", 5)


@register("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM (SELECT user_id, event_type, ts, event_id FROM events) GROUP BY user_id")
def latest_status(spark, d):
    return J.latest_per(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@register("SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3")
def rate_limit(spark, d):
    return J.over_limit(table(spark, d, "events"), "user_id", "ts", 3, "1 day")


@register("""SELECT o_orderkey AS job_id, CAST(k AS INTEGER) AS page_no FROM (SELECT o_orderkey, unnest(range(1, 8)) AS k FROM orders)
 WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k)""")
def missing_pages(spark, d):
    jobs = _jobs(spark, d).select("job_id", F.lit(7).alias("total"))
    return J.missing_units(jobs, _pages(spark, d), "job_id", "page_no", "total")


@register("""SELECT c_custkey AS id, c_name AS name, 'old' AS origin FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, min(upper(c_name)), 'new' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 GROUP BY 1""")
def insert_absent(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("origin"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("new").alias("origin"))
    return J.insert_absent(old, new, ["id"])


@register("""WITH a AS (SELECT DISTINCT o_custkey AS session, o_orderkey AS doc_id FROM orders),
 r AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 2 = 0 THEN [c_custkey, c_custkey + 1] ELSE [] END AS req FROM customer)
 SELECT session, unnest(req) AS doc_id FROM r WHERE len(req) > 0
 UNION ALL SELECT r.session, a.doc_id FROM r JOIN a ON a.session = r.session WHERE len(req) = 0""")
def session_scope(spark, d):
    """Explicit ids if there are any, else the session's attachments."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("session"))
    req = F.when(F.col("session") % 2 == 0, F.array("session", F.col("session") + 1)).otherwise(F.array().cast("array<bigint>"))
    asked = c.withColumn("req", req)
    attached = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("doc_id")).distinct()
    explicit = asked.select("session", F.explode("req").alias("doc_id"))
    fallback = asked.where(F.size("req") == 0).select("session").join(attached, "session")
    return explicit.unionByName(fallback)
