"""A keyed table rewrites the buckets that a change touches, and commits whole versions."""

import pytest
from pyspark.sql import functions as F

from leafmill.sources import keyed as K
from leafmill.streaming import jobs as J

SCHEMA = "id long, part string, v string"


def table(spark, tmp_path, rows=(), buckets=16):
    made = K.KeyedTable.create(spark, str(tmp_path / "table"), spark.createDataFrame([], SCHEMA).schema, ["id", "part"], buckets)
    if rows:
        made.upsert(spark.createDataFrame(rows, SCHEMA))
    return made


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=str)


def test_upsert_of_one_percent_rewrites_its_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path, buckets=200)
    t.upsert(spark.range(2_000).select("id", F.lit("p").alias("part"), F.lit("old").alias("v")))
    before = t.manifest()
    change = t.upsert(spark.range(0, 2_000, 100).select("id", F.lit("p").alias("part"), F.lit("new").alias("v")))
    after = t.manifest()
    changed = {b for b in range(200) if before.files.get(b) != after.files.get(b)}
    assert change.rows == 20 and changed == set(change.touched) and 1 <= len(changed) <= 20
    assert t.read().groupBy("v").count().orderBy("v").collect() == [("new", 20), ("old", 1_980)]
    assert t.read(1).where("v = 'new'").isEmpty()  # old versions stay readable
    asked = spark.createDataFrame([(100, "p"), (101, "p"), (5_000, "p")], "id long, part string")
    assert sorted(r["v"] for r in t.lookup(asked).collect()) == ["new", "old"]


def test_nulls_ties_and_empty_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == []
    t.upsert(spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, None, "x"), (2, "q", None)], SCHEMA))
    assert held(t) == [(1, None, "b"), (2, "q", None), (None, None, "x")]
    t.upsert(spark.createDataFrame([(None, None, "y")], SCHEMA))
    assert (None, None, "y") in held(t) and len(held(t)) == 3
    t.upsert(spark.createDataFrame([], SCHEMA))
    assert len(held(t)) == 3
    t.update(spark.createDataFrame([(2, "q", "set"), (9, "q", "nobody")], SCHEMA), "v")
    assert held(t) == [(1, None, "b"), (2, "q", "set"), (None, None, "y")]
    t.delete(spark.createDataFrame([(1, None), (2, "other"), (None, None)], "id int, part string"))
    assert held(t) == [(2, "q", "set")]
    t.delete(spark.createDataFrame([(2, "q")], "id long, part string"))
    assert held(t) == [] and held(t, 1)


def test_a_killed_change_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, [(1, "a", "x")])
    monkeypatch.setattr(t, "_put", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.upsert(spark.createDataFrame([(1, "a", "lost"), (2, "b", "lost")], SCHEMA))
    again = K.KeyedTable(spark, t.path)
    assert held(again) == [(1, "a", "x")] and again.versions() == [0, 1]
    assert again.vacuum() > 0 and held(again) == [(1, "a", "x")] and again.vacuum() == 0


def test_writers_that_race_lose_no_change(spark, tmp_path):
    t, other = table(spark, tmp_path, [(k, "a", "x") for k in range(40)]), K.KeyedTable(spark, str(tmp_path / "table"))
    put, once = t._put, []

    def raced(manifest):
        if not once:
            once.append(1)
            other.upsert(spark.createDataFrame([(1, "a", "theirs"), (50, "a", "theirs")], SCHEMA))
        return put(manifest)

    t._put = raced
    t.upsert(spark.createDataFrame([(1, "a", "mine"), (2, "a", "mine"), (60, "a", "mine")], SCHEMA))
    rows = {r[0]: r[2] for r in held(t)}
    assert (rows[1], rows[2], rows[50], rows[60], rows[3]) == ("mine", "mine", "theirs", "mine", "x") and len(rows) == 42


def test_batches_commit_once(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    assert t.upsert(rows, "s", 0).version == 1 and t.upsert(rows, "s", 0) is None and t.upsert(rows, "other", 0).version == 2
    with pytest.raises(ValueError):
        K.KeyedTable.create(spark, t.path, spark.range(1).schema, ["id"])


def test_stream_upserts_touch_few_buckets_and_replays_none(spark, tmp_path):
    src, path, ck = (str(tmp_path / n) for n in ("src", "table", "ck"))
    spark.range(500).select("id", F.lit("p").alias("part"), F.lit("old").alias("v")).write.parquet(src)
    run = lambda: J.upsert_to(J.read_parquet(spark, src, SCHEMA), path, ["id", "part"], ck, 50).awaitTermination()
    run()
    spark.createDataFrame([(3, "p", "new"), (3, "p", "newer")], SCHEMA).write.mode("append").parquet(src)
    before = K.KeyedTable(spark, path).manifest()
    run()
    after = K.KeyedTable(spark, path).manifest()
    assert sum(before.files.get(b) != after.files.get(b) for b in range(50)) == 1 and list(after.batches.values()) == [1]
    run()  # nothing new
    t = K.KeyedTable(spark, path)
    assert t.manifest().version == after.version and t.read().count() == 500
    assert t.read().where("v <> 'old'").collect() == [(3, "p", "newer")]
