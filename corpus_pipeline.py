"""A corpus pipeline: rejects, near duplicates and benchmark texts go, sources are mixed, ids are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.

Defined results: an empty table passes every stage as an empty one; other columns stay as they are, whatever their
names; texts of any length are judged whole. Null and empty texts end at the first stage, since they fail its base
rules. Rows equal in doc_id and text are one document to the near-duplicate stage, of which the first by all its
columns stays. A null doc_id comes after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontamination, minhash_dedup, mixing, quality_rules, token_output
from leafmill.llm._session import written
from leafmill.llm.queries import OUTPUT_VOCABULARY, _tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; of repeated rows all or none."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id; texts without a word are alone."""
    return minhash_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; null items and those without a word contaminate none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most twice; rows of a null source are a source of their own."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards with their index; the documents as read back from them, one row for each row of docs."""
    return token_output.encode_documents(docs, _tokenizer(OUTPUT_VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: No SQL expresses the stages: weak supervision, sketches, entropy balancing and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
