"""Markdown, text and chunking queries. FX-md renders each order as Markdown, so line items are the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import chunking as C
from leafmill.operators import markdown as M
from leafmill.plans.tables import query, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
register = query(QUERIES, ORACLES)
HEADS = ("Line", "Part", "Supplier", "Flag")


def rendered(spark: SparkSession, d: str, ragged: bool = False) -> DataFrame:
    """(order_id, text): each order as two key-values, a table of its line items and a note."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))

    def row(i):
        values = [i[c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")]
        full = F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
        if not ragged:
            return full
        return F.when(i["l_linenumber"] % 2 == 0, F.concat(F.lit("| "), F.concat_ws(" | ", *values[:3]), F.lit(" |"))).otherwise(full)

    parts = F.concat(
        F.array(F.concat(F.lit("**Order:** "), "o_orderkey", F.lit(" | **Customer:** "), "o_custkey")),
        F.array(F.lit(f"| {' | '.join(HEADS)} |"), F.lit("|---|---|---|---|")),
        F.transform("items", row),
        F.array(F.concat(F.lit("Note: order "), "o_orderkey")),
    )
    return o.select(F.col("o_orderkey").alias("order_id"), F.array_join(parts, "\n").alias("text"))


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS row_no FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@register("SELECT o_orderkey AS order_id, 1 AS table_start, count(*) AS n_rows, 4 AS n_columns FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def table_segments(spark, d):
    return M.table_segments(rendered(spark, d), "order_id")


@register(f"""SELECT l_orderkey AS order_id, 'table' AS section, row_no, h AS header,
 CASE h WHEN 'Line' THEN CAST(l_linenumber AS VARCHAR) WHEN 'Part' THEN CAST(l_partkey AS VARCHAR) WHEN 'Supplier' THEN CAST(l_suppkey AS VARCHAR) ELSE l_returnflag END AS value
 FROM {NUMBERED}, (SELECT unnest(['Line', 'Part', 'Supplier', 'Flag']) AS h)
 UNION ALL SELECT o_orderkey, 'form', 0, 'Order', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT o_orderkey, 'form', 0, 'Customer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT l_orderkey, 'other', count(*) + 3, 'text', 'Note: order ' || l_orderkey FROM {NUMBERED} GROUP BY 1
 UNION ALL SELECT l_orderkey, 'raw', count(*) + 3, 'line', 'Note: order ' || l_orderkey FROM {NUMBERED} GROUP BY 1
 UNION ALL SELECT l_orderkey, 'raw', 0, 'line', '**Order:** ' || l_orderkey || ' | **Customer:** ' || any_value(o_custkey) FROM {NUMBERED} GROUP BY 1
 UNION ALL SELECT l_orderkey, 'raw', i, 'line', CASE i WHEN 1 THEN '| Line | Part | Supplier | Flag |' ELSE '|---|---|---|---|' END FROM (SELECT DISTINCT l_orderkey FROM {NUMBERED}), (SELECT unnest([1, 2]) AS i)
 UNION ALL SELECT l_orderkey, 'raw', row_no + 2, 'line', '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_returnflag || ' |' FROM {NUMBERED}""")
def export_tables_long(spark, d):
    """Form fields, table cells, other text and raw lines of every document, long."""
    return M.as_long(rendered(spark, d), "order_id")


@register(f"""SELECT l_orderkey AS order_id, row_no, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' ||
 CASE WHEN l_linenumber % 2 = 0 THEN '&nbsp;' ELSE l_returnflag END || ' |' AS line FROM {NUMBERED}""")
def sc_11_table_repair(spark, d):
    return M.repaired_rows(rendered(spark, d, ragged=True), "order_id").where("row_no > 0").select("order_id", "row_no", "line")


@register("SELECT o_orderkey AS order_id, 4 AS widest, false AS landscape FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def widest_table(spark, d):
    rows = M.table_segments(rendered(spark, d), "order_id").groupBy("order_id").agg(F.max("n_columns").alias("widest"))
    return rows.withColumn("landscape", F.col("widest") > 6)


@register(f"""SELECT l_orderkey AS order_id, md5('{{"Customer":"' || any_value(o_custkey) || '","Order":"' || l_orderkey || '"}}') AS metadata,
 md5(string_agg(l_linenumber || ',' || l_partkey || ',' || l_suppkey || ',' || l_returnflag, ';' ORDER BY row_no)) AS cells, 'Note: order ' || l_orderkey AS said FROM {NUMBERED} GROUP BY 1""")
def export_json(spark, d):
    """The JSON export, read back and compared cell by cell."""
    out = M.as_json(rendered(spark, d), "order_id")
    parsed = out.select("order_id", "json", F.from_json("json", "metadata map<string,string>, tables array<array<string>>, text array<string>").alias("j"))
    rows = F.transform(F.flatten("j.tables"), lambda r: F.from_json(r, "map<string,string>"))
    line = lambda r: F.array_join(F.array(*[F.element_at(r, F.lit(h)) for h in HEADS]), ",")
    return parsed.select("order_id", F.md5(F.to_json("j.metadata")).alias("metadata"), F.md5(F.array_join(F.transform(rows, line), ";")).alias("cells"), F.array_join("j.text", "|").alias("said"))


@register("""SELECT c_custkey AS id, unnest([0, 0, 3]) AS pos, unnest([0, 1, 0]) AS part, unnest(['Name', 'Segment', 'Executive']) AS label, unnest([c_name, c_mktsegment, 'N' || c_nationkey]) AS value FROM customer""")
def meta_fields(spark, d):
    """Fields of header and footer lines; a field behind a section label takes the label's place."""
    parts = [F.concat(F.lit("**Name:** "), "c_name", F.lit(" | Segment: "), "c_mktsegment"), F.lit("**Heading**"), F.lit("no field | here"), F.concat(F.lit("**Footer:** Executive: N"), "c_nationkey")]
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array(*parts), "\n").alias("text"))
    return M.meta_fields(docs, "id")


@register("""SELECT c_custkey AS id, 0 AS block_start, 2 AS n_fields, 'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment AS block FROM customer
 UNION ALL SELECT c_custkey, 4, 1, 'Nation: ' || c_nationkey FROM customer""")
def form_blocks(spark, d):
    parts = [F.concat(F.lit("Name: "), "c_name"), F.concat(F.lit("Segment: "), "c_mktsegment"), F.lit(""), F.lit("| a | b |"), F.concat(F.lit("Nation: "), "c_nationkey"), F.lit("# End")]
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array(*parts), "\n").alias("text"))
    return M.form_blocks(docs, "id")


@register("""SELECT c_custkey AS id, i AS block_no, ['text', 'key-value', 'table', 'section', 'text'][i + 1] AS kind, CASE i WHEN 3 THEN 'Findings' END AS title,
 [c_name, 'Name: ' || c_name || ';Segment: ' || c_mktsegment, 'a | b;1 | ' || c_nationkey, 'seen: ok;end', 'last'][i + 1] AS said FROM customer, (SELECT unnest(range(5)) AS i)""")
def doc_blocks(spark, d):
    """Blocks of a page by kind: text, fields, a table, a titled section, text after a blank line."""
    parts = ["c_name", F.concat(F.lit("Name: "), "c_name"), F.concat(F.lit("Segment: "), "c_mktsegment"), F.lit("a | b"), F.lit("--|--"), F.concat(F.lit("1 | "), "c_nationkey"), F.lit("Findings:"), F.lit("seen: ok"), F.lit("end"), F.lit(""), F.lit("last")]
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array(*parts), "\n").alias("text"))
    return M.doc_blocks(docs, "id").select("id", "block_no", "kind", "title", F.array_join("lines", ";").alias("said"))


@register("""SELECT c_custkey AS id, 0 AS section_no, 'Summary' AS title, 'Intro ' || c_name AS body FROM customer
 UNION ALL SELECT c_custkey, 1, 'Segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 2, 'Nation', CAST(c_nationkey AS VARCHAR) FROM customer""")
def sc_13_sections(spark, d):
    text = F.concat(F.lit("Intro "), "c_name", F.lit("\n## Segment\n"), "c_mktsegment", F.lit("\n## Nation\n"), F.col("c_nationkey").cast("string"))
    return M.sections(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("text")), "id")


PAGES = "(SELECT doc_id, CAST(p + 1 AS INTEGER) AS page_no, array_to_string(l[p * 20 + 1:p * 20 + 20], chr(10)) AS text FROM (SELECT doc_id, l, unnest(range(0, CAST(ceil(len(l) / 20) AS BIGINT))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return C.pages(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@register(f"SELECT doc_id, page_no, CASE WHEN length(trim(text)) > 100 THEN 'native' ELSE 'model' END AS route FROM {PAGES}")
def page_route(spark, d):
    """Enough text is kept as it is, the rest goes to a model."""
    return pages(spark, d).select("doc_id", "page_no", F.when(F.length(F.trim("text")) > 100, "native").otherwise("model").alias("route"))


@register(f"SELECT doc_id, page_no, length(text) AS n FROM {PAGES} WHERE length(trim(text)) >= 10")
def nonempty_pages(spark, d):
    return pages(spark, d).where(F.length(F.trim("text")) >= 10).select("doc_id", "page_no", F.length("text").alias("n"))


@register(f"""SELECT doc_id, md5(CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg('---' || chr(10) || '### Page ' || page_no || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) END) AS h FROM {PAGES} GROUP BY 1""")
def merge_pages(spark, d):
    return C.merged(pages(spark, d), "doc_id").select("doc_id", F.md5("text").alias("h"))


@register(f"""SELECT doc_id, CAST((page_no - 1) // 2 AS BIGINT) AS group_no, md5(string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no)) AS h FROM {PAGES} GROUP BY 1, 2""")
def page_groups(spark, d):
    grouped = pages(spark, d).withColumn("group_no", F.floor((F.col("page_no") - 1) / 2))
    return C.joined(grouped, ["doc_id", "group_no"], "page_no", F.col("text"), C.PAGE_BREAK).select("doc_id", "group_no", F.md5("text").alias("h"))


@register(f"""WITH fp AS (SELECT doc_id, page_no, text, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS f FROM {PAGES})
 SELECT doc_id, page_no, CASE WHEN c < page_no THEN 'Page ' || page_no || ' (duplicate of Page ' || c || ')' ELSE 'Page ' || page_no END AS label,
 md5(first_value(text) OVER (PARTITION BY doc_id, f ORDER BY page_no)) AS h, 'p' || c AS predictions
 FROM (SELECT *, min(page_no) OVER (PARTITION BY doc_id, f) AS c FROM fp)""")
def duplicate_pages(spark, d):
    """Pages with equal normalised text take over text and predictions of the first; they keep their own label."""
    fp = F.md5(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    rows = pages(spark, d).withColumn("predictions", F.concat(F.lit("p"), "page_no"))
    return C.duplicates(rows, "doc_id", fp).select("doc_id", "page_no", "label", F.md5("text").alias("h"), "predictions")


@register("""SELECT doc_id, CAST(i AS INTEGER) AS page_no, CASE doc_id % 3 WHEN 0 THEN 'Sheet ' || i WHEN 1 THEN 'Page ' || (i + 1) ELSE 'Document' END AS label,
 md5(CASE WHEN doc_id % 3 = 2 THEN text WHEN i = 0 THEN lang ELSE source END) AS h
 FROM (SELECT *, unnest(CASE WHEN doc_id % 3 = 2 THEN [0] ELSE [0, 1] END) AS i FROM documents)""")
def page_shapes(spark, d):
    """Pages from a list, from a map or from the whole text, as the metadata has them."""
    docs = table(spark, d, "documents")
    listed = F.to_json(F.struct(F.array(*[F.struct(F.lit(f"Sheet {i}").alias("label"), F.col(c).alias("text")) for i, c in enumerate(("lang", "source"))]).alias("pages")))
    mapped = F.to_json(F.struct(F.create_map(F.lit("1"), F.col("lang"), F.lit("2"), F.col("source")).alias("page_texts")))
    docs = docs.withColumn("metadata", F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, mapped))
    return C.pages_of(docs, "doc_id").select("doc_id", "page_no", "label", F.md5("text").alias("h"))


PACKED = """SELECT k, o, n, x, length(x) AS at, 0 AS part FROM u WHERE n = 1 UNION ALL
 SELECT u.k, u.o, u.n, u.x, CASE WHEN f.at + 2 + length(u.x) > 2000 THEN length(u.x) ELSE f.at + 2 + length(u.x) END, CASE WHEN f.at + 2 + length(u.x) > 2000 THEN part + 1 ELSE part END
 FROM f JOIN u ON u.k = f.k AND u.o = f.o AND u.n = f.n + 1"""


@register(f"""WITH RECURSIVE p AS (SELECT doc_id AS k, page_no AS o, replace(text, chr(10), chr(10) || chr(10)) AS t FROM {PAGES} WHERE length(trim(replace(text, chr(10), chr(10) || chr(10)))) >= 10),
 w AS (SELECT k, o, x, i FROM (SELECT k, o, unnest(string_split(t, chr(10) || chr(10))) AS x, unnest(range(0, len(string_split(t, chr(10) || chr(10))))) AS i FROM p WHERE length(t) > 2000)),
 u AS (SELECT k, o, x, row_number() OVER (PARTITION BY k, o ORDER BY i) AS n FROM w WHERE regexp_matches(x, '[^ \\n\\t\\r]')), f AS ({PACKED}),
 c AS (SELECT k, o, 0 AS part, t FROM p WHERE length(t) <= 2000 UNION ALL SELECT k, o, part, string_agg(x, chr(10) || chr(10) ORDER BY n) FROM f GROUP BY 1, 2, 3)
 SELECT k AS doc_id, o AS page_no, CAST(part AS INTEGER) AS chunk_index, CAST(length(t) AS INTEGER) AS n, md5(t) AS h FROM c""")
def chunk_pack(spark, d):
    """Pages whose lines are paragraphs, packed to chunks of 2000 characters."""
    paras = pages(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return C.chunks(paras, ["doc_id", "page_no"]).select("doc_id", "page_no", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("h"))


LINES = f"""(SELECT l_orderkey AS k, row_no AS n, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_returnflag || ' |' AS x FROM {NUMBERED})"""


@register(f"""WITH RECURSIVE u AS {LINES}, f AS (SELECT k, n, x, 12 + length(x) AS at, 0 AS part FROM u WHERE n = 1 UNION ALL
 SELECT u.k, u.n, u.x, CASE WHEN f.at + 1 + length(u.x) > 70 THEN 12 + length(u.x) ELSE f.at + 1 + length(u.x) END, CASE WHEN f.at + 1 + length(u.x) > 70 THEN part + 1 ELSE part END
 FROM f JOIN u ON u.k = f.k AND u.n = f.n + 1)
 SELECT k AS order_id, CAST(part AS INTEGER) AS part_no, '| a |' || chr(10) || '|---|' || chr(10) || string_agg(x, chr(10) ORDER BY n) AS part FROM f GROUP BY 1, 2""")
def table_split(spark, d):
    """Oversized tables cut between rows; every part has the header."""
    rows = M.tables(rendered(spark, d), "order_id").where(F.size("rows") > 1).select("order_id", F.slice("rows", F.lit(2), F.size("rows") - 1)["line"].alias("r"))
    parts = C.split_table(F.lit("| a |"), F.lit("|---|"), F.col("r"), 70)
    return rows.select("order_id", F.posexplode(parts).alias("part_no", "part"))


@register("""SELECT l_orderkey AS k, l_linenumber AS n, 'item' || l_partkey AS compact, CASE WHEN l_linenumber % 4 IN (0, 1) THEN 'item' || CASE WHEN l_linenumber % 4 = 1 THEN ' ' ELSE '' END || l_partkey ELSE 'item-' || l_partkey END AS normal FROM lineitem""")
def sc_1_2_codes(spark, d):
    """Codes in four spellings, normalised and compact."""
    code = spelled(F.col("l_partkey"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), X.compact_code(code).alias("compact"), X.normalize_code(code).alias("normal"))


def spelled(part, n):
    return (
        F.when(n % 4 == 0, F.concat(F.lit("ITEM"), part))
        .when(n % 4 == 1, F.concat(F.lit(" item  "), part))
        .when(n % 4 == 2, F.concat(F.lit("Item-"), part))
        .otherwise(F.concat(F.lit("ITEM–"), part))
    )


@register("""SELECT doc_id, md5(regexp_replace(text, '<\\|.*?\\|>', '', 'g')) AS cleaned, '{"k": ' || doc_id || '}' AS payload, 'Bullet ' || doc_id AS bullet, 'a,b' || doc_id AS asked,
 '[' || doc_id || ' → ' || lang || ']' AS note,
 CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN CAST(round(n_chars / 1024) AS BIGINT) || ' KB' ELSE '' END AS bytes,
 CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS media,
 md5(trim(text)) AS said FROM documents""")
def sc_5_7_15_16_27_29_text(spark, d):
    """Marks of a model around and inside whole texts, taken off again."""
    docs = table(spark, d, "documents")
    raw = F.concat(F.lit("noise<|text|><think>hm\nso</think>"), "text", F.lit("</|text|>tail"))
    inside = F.regexp_replace("text", " ", " <|a|>")  # all over the text
    return docs.select(
        "doc_id",
        F.md5(X.strip_controls(inside)).alias("cleaned"),
        X.json_payload(F.concat(F.lit('Sure:\n```json\n{"k": '), "doc_id", F.lit("}\n```"))).alias("payload"),
        X.strip_bullet(F.concat(F.lit("- 3) Bullet "), "doc_id")).alias("bullet"),
        F.array_join(X.string_list(F.concat(F.lit('```json\n["a", "b'), "doc_id", F.lit('", "c"]\n```')), 2), ",").alias("asked"),
        X.annotation(F.col("doc_id").cast("string"), F.lit("ITEM"), F.col("lang"), F.lit(None), F.lit(None)).alias("note"),
        X.byte_size(F.col("n_chars")).alias("bytes"),
        X.media_type(F.element_at(F.array(F.lit("a.PDF"), F.lit("b.jpeg"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("media"),
        F.md5(X.clean_output(raw)).alias("said"),
    )


@register("""SELECT l_orderkey AS k, l_linenumber AS n, round(CASE WHEN l_discount * 10 < 0.3 THEN 0.2 * least(1, l_tax * 10) + 0.8 * l_discount * 10 ELSE 0.4 * least(1, l_tax * 10) + 0.6 * least(1, l_discount * 10) END, 6) AS fused,
 CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y-%m-01') WHEN 2 THEN strftime(l_shipdate, '%Y-01-01') END AS day FROM lineitem""")
def sc_20_22_scores_dates(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 4
    text = F.when(n == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(n == 1, F.date_format("l_shipdate", "yyyy-MM")).when(n == 2, F.date_format("l_shipdate", "yyyy")).otherwise("soon")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.round(X.fuse_confidence(F.col("l_tax") * 10, F.col("l_discount") * 10), 6).alias("fused"),
        F.date_format(X.parse_date(text), "yyyy-MM-dd").alias("day"),
    )


@register("""SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS nation, 'x' AS extra, CASE WHEN c_custkey % 5 = 0 THEN 'Table' WHEN c_custkey % 5 = 1 THEN 'Figure' ELSE 'Paragraph' END AS region,
 CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a' END AS winner FROM customer""")
def sc_17_24_maps_first_valid(spark, d):
    c = table(spark, d, "customer")
    m = X.map_upsert(X.map_upsert(F.create_map(F.lit("nation"), F.lit("old")), F.lit("nation"), F.col("c_nationkey").cast("string")), F.lit("extra"), F.lit("x"))
    name = F.when(F.col("c_custkey") % 5 == 0, "big_Table_1").when(F.col("c_custkey") % 5 == 1, "Image block").otherwise("text")
    rows = c.withColumn("a", F.when(F.col("c_custkey") % 2 == 0, " no ").otherwise("a long one")).withColumn("b", F.lit("second"))
    return rows.select(F.col("c_custkey").alias("id"), m["nation"].alias("nation"), m["extra"].alias("extra"), X.region_type(name).alias("region"), X.first_valid(["a", "b"])[1].alias("winner"))


HEADED = """unnest(['**' || p_type || '**', '  **' || p_name || '** ', '**Brand:** ' || p_brand, '**' || p_name || ' | ' || p_type || '**', '**a** and **' || p_type || '**', '***' || p_brand || '***', p_name || '**', '****'])"""


@register(f"""WITH l AS (SELECT p_partkey AS id, unnest(range(0, 8)) AS pos, {HEADED} AS line FROM part), t AS (SELECT id, pos, trim(line) AS s FROM l)
 SELECT id, CAST(pos AS INTEGER) AS pos, regexp_replace(regexp_replace(s, '^\\*\\*', ''), '\\*\\*$', '') AS title FROM t
 WHERE starts_with(s, '**') AND ends_with(s, '**') AND length(s) - length(replace(s, '**', '')) = 4 AND NOT contains(s, ':') AND NOT contains(s, '|')""")
def section_headings(spark, d):
    p = table(spark, d, "part")
    made = [
        F.concat(F.lit("**"), "p_type", F.lit("**")), F.concat(F.lit("  **"), "p_name", F.lit("** ")), F.concat(F.lit("**Brand:** "), "p_brand"), F.concat(F.lit("**"), "p_name", F.lit(" | "), "p_type", F.lit("**")),
        F.concat(F.lit("**a** and **"), "p_type", F.lit("**")), F.concat(F.lit("***"), "p_brand", F.lit("***")), F.concat("p_name", F.lit("**")), F.lit("****"),
    ]
    return M.headings(p.select(F.col("p_partkey").alias("id"), F.array_join(F.array(*made), "\n").alias("text")), "id")
