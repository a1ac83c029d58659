"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    conversation_trie,
    decontamination,
    language_id,
    minhash_dedup,
    mixing,
    quality_rules,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    token_alignment,
    token_counts,
    token_output,
    toxicity,
)

TOKEN_MODEL = "piece_bpe_32k.model"
OUTPUT_VOCABULARY = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer(TOKEN_MODEL))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies", "rate"]
    return mixing.mix(_table(spark, sf_dir, "documents")).select(columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.digest(decontamination.contamination(docs, benchmark))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer(OUTPUT_VOCABULARY))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(_table(spark, sf_dir, "documents"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(_table(spark, sf_dir, "documents"), *map(_tokenizer, ALIGNED))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.with_openings(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_output": op8_token_output,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
    "pipeline": pipeline,
}

OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20
), wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM starts
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM wins
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1
), g AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w
), kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
  WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM bs
), sizes AS (
  SELECT DISTINCT k FROM bw
), ds AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS h FROM ds
), m AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.h = bw.h
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || coalesce(text, ''))) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  ), 4294967295) % 6 AS h FROM ids
), heads AS (
  SELECT c.conv_id, t.pos, t.turn FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= c.h
), given AS (
  SELECT conv_id, count(*) AS m FROM heads GROUP BY conv_id
), r AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv_id, t.pos - h + coalesce(m, 0), t.turn FROM t JOIN c ON c.conv_id = t.conv_id LEFT JOIN given ON given.conv_id = t.conv_id WHERE t.pos > h
), q AS (
  SELECT c.conv_id, coalesce(list(turn ORDER BY pos) FILTER (turn IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, len(turns) AS n, d, turns[1:d] AS k FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM q)
), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(k)[d].text), 0) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY k, d
), above AS (
  SELECT x.conv_id, x.d, y.conv_id AS a_conv, y.d AS a_d, x.n_convs, x.chars
  FROM nodes x JOIN p ON p.conv_id = x.conv_id AND p.d <= x.d JOIN nodes y ON y.d = p.d AND y.k = p.k
), children AS (
  SELECT a_conv, a_d, count(*) AS n FROM above WHERE a_d = d - 1 GROUP BY a_conv, a_d
), totals AS (
  SELECT above.a_conv, above.a_d, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n IS NULL) AS leaves
  FROM above LEFT JOIN children ON children.a_conv = above.conv_id AND children.a_d = d GROUP BY above.a_conv, above.a_d
)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, above.a_conv AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM nodes JOIN totals ON totals.a_conv = nodes.conv_id AND totals.a_d = nodes.d
LEFT JOIN children ON children.a_conv = nodes.conv_id AND children.a_d = nodes.d
LEFT JOIN above ON above.conv_id = nodes.conv_id AND above.d = nodes.d AND above.a_d = nodes.d - 1
"""

ORACLES: dict[str, str] = {"op4_substring_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op13_conversation_trie": OP13_SQL}
