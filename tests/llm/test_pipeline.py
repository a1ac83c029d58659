"""The stages of the pipeline on a small corpus with planted cases, nulls, repeats and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import decontamination, minhash_dedup, mixing, quality_rules

P = pytest.importorskip("public_tokenizers")


def corpus(rng):
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(d, prose(rng.randrange(40, 120)), f"s{d % 3}" if d % 9 else None) for d in range(90)]
    near = rows[5][1].split()
    near[3] = "changed"
    planted = {
        "copy": [(200, rows[4][1], "s0"), (201, " ".join(near), "s1")],
        "bad": [(210 + k, " ".join(f"{w}%%%" for w in prose(60).split()), "s0") for k in range(8)] + [(220, "too short", "s1"), (221, None, "s1"), (222, "", None), (223, "a b c d e f g h " * 9, "s2")],
        "contaminated": [(230, prose(40) + " " + item.upper() + " " + prose(20), "s2")],
        "repeat": [(240, rows[7][1] + " more", "s1"), (240, rows[7][1] + " more", "s1")],
        "null": [(None, prose(50), "s2")],
    }
    return rows, planted, [(1, item), (2, None), (3, "")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, planted, items = corpus(random.Random(3))
    folder = str(tmp_path_factory.mktemp("sf"))
    everything = rows + [r for group in planted.values() for r in group]
    docs = spark.createDataFrame(everything, "doc_id long, text string, source string").withColumn("lang", F.lit("xx")).withColumn("n_chars", F.length("text"))
    for name in ("kept", "row", "s", "doc", "tie", "copies", "size", "label", "n"):  # names that operators use themselves
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, planted


def test_each_stage_does_its_part(spark, made):
    folder, rows, planted = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    gone = {r[0] for r in planted["bad"]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = ids(docs)
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = corpus_pipeline.written(docs, "stage")
        lost = set(before) - set(ids(docs))
        if name == "quality rules":
            assert lost == gone
        elif name == "near duplicates":
            assert lost == {200, 201, 240} and len(ids(docs)) == len(set(ids(docs)))
        elif name == "decontamination":
            assert lost == {230}
        else:
            sizes = {r["source"]: r["n"] for r in docs.select("source", F.explode(F.array(mixing.size(F.col("text")))).alias("k")).groupBy("source").agg(F.sum("k").alias("n")).collect()}
            assert all(ids(docs).count(d) <= 2 for d in set(ids(docs))) and set(sizes) == {None, "s0", "s1", "s2"}


def test_run_reads_back_what_the_mix_took(spark, made):
    folder, _, _ = made
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    rows = sorted(out, key=lambda r: r["start"])
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


def test_stages_take_empty_tables(spark, made):
    folder, _, _ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 99999")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    for out in (quality_rules.keep_good(docs), minhash_dedup.keep_first(docs), decontamination.drop_contaminated(docs, benchmark), mixing.mixed(docs)):
        assert out.columns == docs.columns and out.count() == 0
    some = spark.read.parquet(f"{folder}/documents.parquet")
    assert decontamination.drop_contaminated(some, benchmark.where("item_id = 0")).count() == some.count()
