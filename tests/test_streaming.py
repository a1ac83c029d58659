"""Streams equal their batch twins, and replays change nothing."""

import json

from pyspark.sql import functions as F

from leafmill.operators.jobs import over_limit
from leafmill.sources import catalogs, sinks
from leafmill.sources.keyed import KeyedTable
from leafmill.streaming import jobs as S


def test_append_takes_only_what_is_new(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(src)
        S.append_to(S.read_parquet(spark, src, spark.read.parquet(src).schema), out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == (k + 1) * 10


def test_upserts_are_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(src)
    for ck in ("c1", "c2"):  # a fresh checkpoint replays everything
        S.upsert_to(S.read_parquet(spark, src, "id long, v string"), out, ["id"], str(tmp_path / ck)).awaitTermination()
    table = KeyedTable(spark, out)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
    assert table.versions() == [0, 1, 2]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [("u1", f"2024-01-01 00:00:{s:02d}") for s in range(12)] + [("u2", "2024-01-01 00:00:01"), ("u9", "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "user string, t string").select("user", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "src"))
    q = S.rate_limited(S.read_parquet(spark, str(tmp_path / "src"), df.schema), "user", "ts", 10).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = [tuple(r) for r in over_limit(df, "user", "ts", 10).collect()]
    assert [tuple(r) for r in spark.table("limited").collect()] == want and want[0][2] == 12


def test_sessions_are_assembled(spark, tmp_path):
    lines = [{"type": "token", "session": 1, "seq": i, "token": w} for i, w in enumerate("a b c".split())] + [{"type": "citations", "session": 1, "seq": -1, "citations": ["[1]"]}, {"type": "done", "session": 1, "seq": -1, "token": ""}, {"type": "token", "session": 2, "seq": 0, "token": "x"}]
    df = spark.createDataFrame([("data: " + json.dumps(x),) for x in lines], "l string")
    df.write.parquet(str(tmp_path / "src"))
    stream = S.read_parquet(spark, str(tmp_path / "src"), df.schema).select(S.sse_tokens(F.col("l")).alias("t")).select("t.*")
    q = S.assemble(stream).writeStream.format("memory").queryName("said").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("said").collect()] == [(1, "a b c", ["[1]"])]


def test_versions_and_binary_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_table(spark.range(3), path) == 1
    assert sinks.write_table(sinks.deleted(sinks.read_table(spark, path), spark.range(1), ["id"]), path) == 2
    assert sinks.read_table(spark, path).count() == 2
    assert sinks.append(spark.range(7, 9), path) == 2 and sinks.read_table(spark, path).count() == 4
    for name, text in (("a", "x"), ("b", "x"), ("c", "y")):
        (tmp_path / f"{name}.bin").write_text(text)
    assert sorted(r["n"] for r in catalogs.read_files(spark, str(tmp_path / "*.bin")).collect()) == [1, 2]


def test_bad_rows_are_set_aside(spark):
    df = spark.createDataFrame([(1, "PENDING", "5"), (2, "PENDING", "x"), (3, "COMPLETED", None)], "id int, status string, v string")
    good, bad = S.quarantine(df, F.col("v").try_cast("int").isNotNull(), F.lit("no number"))
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["status"] for r in bad.collect()} == {2: "FAILED", 3: "COMPLETED"}


def test_replayed_pages_count_once(spark, tmp_path):
    rows = [("j1", 1, 2), ("j1", 1, 2), ("j2", 1, 2), ("j2", 2, 2), ("j2", 2, 2)]
    df = spark.createDataFrame(rows, "job string, page int, total int")
    df.write.parquet(str(tmp_path / "src"))
    q = S.completed(S.read_parquet(spark, str(tmp_path / "src"), df.schema), "job", "total", "page").writeStream.format("memory").queryName("full").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("full").collect()] == [("j2", 2, 2)] == [tuple(r) for r in S.completed(df, "job", "total", "page").collect()]


def test_two_changes_of_a_key_update_one_row(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    got = sinks.updated(old, spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string"), "id", "v")
    assert sorted((r["id"], r["v"], r["changed"]) for r in got.collect()) == [(1, "y", True), (2, "b", False)]
