"""Kept indexes, fingerprints, rules and model seams against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import classify as C
from leafmill.operators import images as I
from leafmill.operators import lexical_index as LX
from leafmill.operators import models as MD
from leafmill.operators import records as R
from leafmill.operators import retrieval as RT
from leafmill.operators import vector_index as VX
from leafmill.plans import stores


def test_recall_of_codes_and_cells(spark, tmp_path):
    """The ids that 50 divides ask all vectors."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.col("embedding").alias("v"))
    VX.build_index(v, "tenant", str(tmp_path / "i"))
    index = VX.load_index(spark, str(tmp_path / "i"))
    asked = v.where("id % 50 = 0")
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in RT.dense_top_k(asked, v, "tenant", 20).collect()}
    for share, least in ((VX.PROBED, 0.9), (1.0, 0.99)):
        found = {(r["query_id"], r["vec_id"]): r["score"] for r in VX.search(asked, index, "tenant", 20, probed=share).collect()}
        met = exact.keys() & found.keys()
        assert len(met) >= least * len(exact) and all(exact[x] == found[x] for x in met)
    few = VX.search(v.where("id = 50"), index, "tenant", 5, probed=1.0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4, 5] and {(50, r["vec_id"]) for r in few} <= exact.keys()


def test_vectors_of_no_length_and_empty_tables(spark, tmp_path):
    schema = "id long, tenant string, v array<float>"
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, None, [0.5, 0.5]), (4, None, [0.0, 1.0]), (5, "a", [0.0, 0.0]), (6, "a", None), (7, "b", [1.0, 1.0])]
    index = VX.build_index(spark.createDataFrame(rows, schema), "tenant", str(tmp_path / "some"))
    got = VX.search(spark.createDataFrame([*rows, (9, "a", [1.0, 2.0, 3.0])], schema), index, "tenant", 3, probed=1.0).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 0.707107), (4, 3, 0.707107)]
    none = VX.build_index(spark.createDataFrame([], schema), "tenant", str(tmp_path / "none"))
    assert VX.search(spark.createDataFrame(rows, schema), none, "tenant", 3).count() == 0
    assert VX.search(spark.createDataFrame([], schema), index, "tenant", 3).count() == 0


def test_kept_lexical_index_equals_scoring_all(spark, tmp_path):
    rng = random.Random(4)
    common, rare = [f"w{k}" for k in range(30)], [f"r{k}" for k in range(400)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randrange(1, 60))) for _ in range(900)] + [None, "", "w1 w1 w1"]
    chunks = spark.createDataFrame([(f"c{k:04}", t) for k, t in enumerate(texts)], "chunk_id string, text string").cache()
    asked = spark.createDataFrame([(q, f"r{q} {common[q % 30]} r{q + 7} unseen") for q in range(40)] + [(50, ""), (51, None), (52, "w1")], "query_id long, text string").cache()
    index = LX.create(chunks.where("chunk_id < 'c0300'"), str(tmp_path / "i"), ranges=64)
    LX.append(chunks.where("chunk_id >= 'c0300'"), index)
    for k in (3, 20):
        want = sorted(map(tuple, RT.bm25_top_k(asked, chunks, k).collect()))
        assert sorted(map(tuple, LX.search(asked, index, k).collect())) == want
        assert sorted(map(tuple, LX.search(asked, index, k, first=1).collect())) == want
    assert sorted(map(tuple, LX.search(asked, index, 3, use_idf=False).collect())) == sorted(map(tuple, RT.bm25_top_k(asked, chunks, 3, use_idf=False).collect()))
    some, every = LX.opened(asked, index, 3, first=2)
    assert some < 0.7 * every
    empty = LX.create(chunks.limit(0), str(tmp_path / "none"))
    assert LX.search(asked, empty, 3).count() == 0


def image(seed, side=48):
    """A page: light, with dark blocks."""
    rng = np.random.default_rng(seed)
    page = np.full((side, side), 230.0)
    for _ in range(9):
        y, x, h, w = rng.integers(0, side - 8), rng.integers(0, side - 8), *rng.integers(3, 20, 2)
        page[y : y + h, x : x + w] = rng.integers(0, 120)
    return page


def test_fingerprints_of_copies_agree():
    for seed in range(20):
        page = image(seed)
        own = I.perceptual_hash(page.ravel(), 48)
        large = np.kron(page, np.ones((3, 3)))
        assert I.perceptual_hash(large.ravel(), 144) == own and I.perceptual_hash((page * 0.8 + 20).ravel(), 48) == own
        noisy = page + np.random.default_rng(seed).normal(0, 2, page.shape)
        assert ((I.perceptual_hash(noisy.ravel(), 48) ^ own) & (2**64 - 1)).bit_count() <= 6
        assert ((I.perceptual_hash(image(seed + 100).ravel(), 48) ^ own) & (2**64 - 1)).bit_count() > 10


def test_lowest_page_is_canonical(spark):
    rows = [("a", 5, 0b1111), ("a", 2, 0b1111), ("a", 7, 0b0111), ("a", 9, -1), ("a", 1, None), ("a", 3, None), ("b", 1, 0b1111), ("b", 4, 0b1111 | 1 << 62 | 1 << 31), ("c", 2, 0)]
    pages = spark.createDataFrame(rows, "doc string, page int, fp long")
    got = {(r["doc"], r["page"]): r["canonical_page"] for r in I.canonical_pages(pages, "doc", "page", "fp").collect()}
    assert got == {("a", 5): 2, ("a", 2): 2, ("a", 7): 7, ("a", 9): 9, ("a", 1): 1, ("a", 3): 3, ("b", 1): 1, ("b", 4): 4, ("c", 2): 2}
    near = {(r["doc"], r["page"]): r["canonical_page"] for r in I.canonical_pages(pages, "doc", "page", "fp", 2).collect()}
    assert near == got | {("a", 7): 2, ("b", 4): 1}
    frames = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([], 2), (None, 2), ([1.0, 2.0], None), ([float(k % 7) for k in range(64)], 8)], "px array<double>, width int")
    assert [r[0] is None for r in frames.select(I.page_fingerprint(F.col("px"), F.col("width"))).collect()] == [True] * 4 + [False]


def test_rules_equal_a_loop_and_need_no_nested_loop(spark):
    rng = random.Random(6)
    rules = [(k, rng.sample(["f", "g", "h"], rng.randrange(0, 3)), [f"v{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))], rng.choice([None, None, 0, 1, 17, 64, 65, 90, 70_000]), f"s{k % 3}") for k in range(300)]
    facts = [(p, rng.choice(["f", "g", "x", None]), rng.choice([f"v{rng.randrange(60)}", None])) for p in range(80) for _ in range(3)]
    ages = [(p, rng.choice([None, 0, 1, 16, 17, 63, 64, 65, 66, 89, 90, 127, 128, 80_000])) for p in range(80)]
    want = set()
    for k, fields, values, least, severity in rules:
        want |= {(p, k, severity) for p, f, v in facts if v is not None and v in values and (not fields or f in fields)}
        want |= {(p, k, severity) for p, a in ages if a is not None and least is not None and a >= least}
    tables = spark.createDataFrame(facts, "id long, field string, value string"), spark.createDataFrame(ages, "id long, age int")
    got = R.rule_alerts(*tables, spark.createDataFrame(rules, "rule_id int, fields array<string>, values array<string>, age_threshold int, severity string"), "id")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    many = spark.range(100_000).select(F.col("id").alias("rule_id"), F.array(F.lit("f")).alias("fields"), F.array(F.concat(F.lit("v"), "id")).alias("values"), (F.col("id") % 90 + 40).cast("int").alias("age_threshold"), F.lit("low").alias("severity"))
    alerts = R.rule_alerts(*tables, many, "id")
    plan = alerts._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and alerts.count() > 0


def test_a_user_scorer_reranks(spark):
    rows = spark.createDataFrame([(1, "a", "q", "long text"), (1, "b", "q", "x"), (1, "c", "q", None), (2, "d", "q", "y")], "query_id long, item string, question string, text string")

    @F.pandas_udf("double")
    def shortest(question, text):
        return 1 / text.str.len()

    got = [(r["query_id"], r["item"], r["rank"]) for r in RT.rerank(rows.withColumn("rank", F.lit(0)), "question", "text", 2, "item", shortest).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b", 1), (1, "a", 2), (2, "d", 1)]


def test_models_are_loaded_by_worker_and_results_kept(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def answer(batch):
            with open(calls, "a") as f:
                f.write("x" * batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(t.as_py() or "") for t in batch.column("text")], pa.int64())], names=["digest", "n"])

        return answer

    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "xy")]
    df = spark.createDataFrame(rows, "id long, text string")
    run = lambda d: {r["id"]: r["n"] for r in MD.map_model_resumed(d, load, "n long", ["text"], str(tmp_path / "held"), 4).collect()}
    assert run(df.where("id < 5")) == {1: 3, 2: 3, 3: 0, 4: 0} and len(open(calls).read()) == 3
    assert run(df) == {1: 3, 2: 3, 3: 0, 4: 0, 5: 2} and len(open(calls).read()) == 4
    assert run(df) == {1: 3, 2: 3, 3: 0, 4: 0, 5: 2} and len(open(calls).read()) == 4
    assert run(df.limit(0)) == {}
    made = []
    assert MD._loaded("n", lambda: made.append(1) or str) is MD._loaded("n", lambda: made.append(1) or str) and made == [1]


@pytest.mark.parametrize("name", ["classifier_accuracy", "classifier_margin"])
def test_spellings_are_classified(spark, name):
    rows = stores.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 20 and sum(r["code"] == r["predicted"] for r in rows) >= 0.8 * len(rows)


def test_classifier_inputs(spark):
    known = spark.createDataFrame([("OD", "od"), ("OD", "o.d"), ("BD", "bd"), ("BD", "b-d"), (None, "x"), ("BD", None)], "code string, variant string")
    asked = spark.createDataFrame([(1, "od"), (2, "b d"), (3, None), (4, "")], "id long, token string")
    got = {r["id"]: r["code"] for r in C.predict(C.fit(known), asked).collect()}
    assert got[1] == "OD" and got[2] == "BD" and got[3] is None and len(got) == 4
    with pytest.raises(ValueError):
        C.fit(known, "other")


def test_classifier_steps_run_no_more_tasks_than_rows_need(spark, monkeypatch):
    parts, plain = [], C._counted
    monkeypatch.setattr(C, "_counted", lambda rows, *rest: parts.append(rows.rdd.getNumPartitions()) or plain(rows, *rest))
    C.fit(spark.createDataFrame([("OD", "od"), ("BD", "bd")] * 8, "code string, variant string").repartition(16))
    assert parts == [1]


def test_texts_of_few_candidates_and_tokens_are_not_shuffled(spark):
    from leafmill.plans import entities, retrieval

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (retrieval.reranked(spark, "/root/testdata/sf0.001"), entities.entity_candidates(spark, "/root/testdata/sf0.001")):
            joins = rows._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
