"""Retrieval queries: benchmark passages ask pages of documents; vectors ask their tenant's vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import lexical_index as LX
from leafmill.operators import retrieval as R
from leafmill.operators import vector_index as VX
from leafmill.operators.sized import is_small, shuffled
from leafmill.plans.markdown import PAGES, pages
from leafmill.plans.tables import query, table
from leafmill.sources.shared import folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
register = query(QUERIES, ORACLES)

CANDIDATES, KEPT = 20, 5
CHUNK = "doc_id || ':' || page_no"
BM25 = f"""p AS (SELECT {CHUNK} AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+') AS t FROM {PAGES} WHERE length(trim(text)) >= 10),
 st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM p),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+')) AS term FROM benchmark),
 x AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM p),
 tf AS (SELECT term, chunk_id, any_value(dl) AS dl, count(*) AS tf FROM x GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 w AS (SELECT tf.term, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df ON df.term = tf.term, st),
 sc AS (SELECT query_id, chunk_id, round(sum(w), 6) AS score FROM q JOIN w ON q.term = w.term GROUP BY 1, 2),
 bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 20)"""


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where(F.length(F.trim("text")) >= 10).select(F.concat_ws(":", "doc_id", "page_no").alias("chunk_id"), "doc_id", "page_no", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark: SparkSession, d: str, k: int = CANDIDATES) -> DataFrame:
    return R.bm25_top_k(questions(spark, d), chunk_table(spark, d), k)


@register(f"WITH {BM25} SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    """Which pages hold this passage? The flagship query."""
    return lexical(spark, d, 5).select("query_id", "chunk_id", "rank")


@register(f"WITH {BM25} SELECT query_id, chunk_id, rank FROM bm")
def bm25_index_topk(spark, d):
    """The same from an index that is kept: two batches are written, then searched without their texts."""
    rows = chunk_table(spark, d).select("chunk_id", "doc_id", "text")
    built = LX.create(rows.where("doc_id % 3 <> 0"), folder(spark, "lexical"))
    LX.append(rows.where("doc_id % 3 = 0"), built)
    return LX.search(questions(spark, d), LX.LexicalIndex(spark, built.path), CANDIDATES).select("query_id", "chunk_id", "rank")


DENSE = """dn AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank
 FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 20)"""


def dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.col("embedding").alias("v"))
    return R.dense_top_k(v.where("id % 50 = 0"), v, "tenant", 20)


@register(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dn")
def dense_topk(spark, d):
    return dense(spark, d).select("query_id", "vec_id", "score", "rank")


@register(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dn")
def dense_index_topk(spark, d):
    """The same from codes of all cells of an index that is kept, the best compared exactly."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.col("embedding").alias("v"))
    path = folder(spark, "vectors")
    VX.build_index(v, "tenant", path)
    return VX.search(v.where("id % 50 = 0"), VX.load_index(spark, path), "tenant", 20, probed=1.0)


@register(f"""WITH {DENSE}, near AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM dn),
 f AS (SELECT query_id, vec_id AS item, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, vec_id, rank FROM dn UNION ALL SELECT query_id, vec_id, rank FROM near) GROUP BY 1, 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, d):
    """Two ranked lists of the same candidates fused."""
    first = dense(spark, d).select("query_id", F.col("vec_id").alias("item"), "rank")
    second = R.top_k(first.withColumn("score", F.lit(0)).drop("rank"), ["query_id"], "score", ["item"], 20).select("query_id", "item", "rank")
    return R.fuse([first, second], 10)


JAC = """rr AS (SELECT bm.query_id, bm.chunk_id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS rerank
 FROM bm JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+')) AS t FROM benchmark) a ON a.item_id = bm.query_id
 JOIN (SELECT chunk_id, list_distinct(t) AS t FROM p) b ON b.chunk_id = bm.chunk_id),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS rank FROM rr) WHERE rank <= 5)"""


def reranked(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    best, asking = lexical(spark, d), asked.withColumnRenamed("text", "question")
    # at most CANDIDATES rows a question: where these are few, no text of a page is shuffled
    few = is_small(asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(CANDIDATES)))))
    found = chunk_table(spark, d).join(F.broadcast(best) if few else shuffled(best), "chunk_id").join(F.broadcast(asking) if is_small(asking) else shuffled(asking), "query_id")
    return R.rerank(found, "question", "text", KEPT, "chunk_id")


@register(f"WITH {BM25}, {JAC} SELECT query_id, chunk_id, rerank, rank FROM top")
def rerank_topn(spark, d):
    return reranked(spark, d).select("query_id", "chunk_id", "rerank", "rank")


@register(f"WITH {BM25}, {JAC} SELECT query_id, chunk_id, rank FROM (SELECT *, max(rerank) OVER (PARTITION BY query_id) AS b FROM top) WHERE b >= 0.3")
def relevance_gate(spark, d):
    return R.relevance_gate(reranked(spark, d), "rerank", 0.3).select("query_id", "chunk_id", "rank")


@register(f"""WITH {BM25}, {JAC} SELECT query_id, md5(string_agg('[' || rank || '] (Source: document ' || doc_id || ', Page ' || page_no || '):' || chr(10) || substr(text, 1, 200), chr(10) || chr(10) ORDER BY rank)) AS h
 FROM top JOIN {PAGES} g ON g.doc_id || ':' || g.page_no = chunk_id GROUP BY 1""")
def citations(spark, d):
    source = F.concat(F.lit("document "), "doc_id", F.lit(", Page "), "page_no")
    return R.citations(reranked(spark, d), source, "text").select("query_id", F.md5("context").alias("h"))


@register("SELECT conv_id, turn, regexp_matches(trim(text), '(?i)^\\s*(summari[sz]e|summary|overview|what is this|tell me about|describe|list all)') AS broad FROM conversations WHERE role = 'user'")
def query_route(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", R.is_broad(F.col("text")).alias("broad"))


@register(f"SELECT doc_id, page_no, md5(text) AS h FROM {PAGES} WHERE page_no <= 8")
def broad_sample(spark, d):
    rows = pages(spark, d).withColumn("chunk_index", F.lit(0))
    return R.broad_sample(rows, "doc_id", "page_no", "chunk_index", 8).select("doc_id", "page_no", F.md5("text").alias("h"))


@register(f"SELECT doc_id, md5(substr(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no), 1, 4000)) AS h FROM {PAGES} WHERE page_no <= 6 GROUP BY 1")
def doc_sample(spark, d):
    return R.head_sample(pages(spark, d), "doc_id", "page_no", 6, 4000).select("doc_id", F.md5("sample").alias("h"))
