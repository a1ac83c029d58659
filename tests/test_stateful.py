"""Streams with ending state equal their batch twins on shuffled, replayed and late input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.streaming import jobs as J
from leafmill.streaming import stateful as S

TOKENS = "session long, seq long, token string, type string, citations array<string>, t string"


@pytest.fixture(autouse=True)
def store(spark):
    with S.state_store(spark):
        yield


def at(minute, second=0):
    return f"2024-01-01 {minute // 60:02}:{minute % 60:02}:{second:02}"


def played(spark, tmp_path, batches, schema, stream, name, first=0):
    """Rows of all micro-batches, one batch a file, in order; what the stream gave, and the last state."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for k, rows in enumerate(batches, first):
        df = spark.createDataFrame(rows, schema).coalesce(1).withColumn("ts", F.to_timestamp("t")).drop("t")
        df.write.mode("append").parquet(f"{src}/batch={k}")
        q = stream(J.read_parquet(spark, src, df.schema, 1)).writeStream.option("checkpointLocation", ck).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return [tuple(r) for r in spark.read.parquet(out).collect()], state


def test_token_streams_append_each_session_once(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for s in range(8):
        n = rng.randrange(0, 12)
        rows += [(s, k, f"w{s}.{k}", "token", None, at(s, k)) for k in range(n)]
        rows += [(s, -1, None, "citations", [f"[{s}]"], at(s)), (s, n, None, "done", None, at(s, 30))]
    twin = spark.createDataFrame(rows, TOKENS).drop("t")
    want = sorted((*map(lambda x: x, r), True) for r in map(tuple, J.assemble(twin).collect()))
    open_ = [(50, 0, "never", "token", None, at(9)), (50, 2, "ends", "token", None, at(9)), (None, 0, "x", "token", None, at(9)), (51, 0, "no time", "token", None, None)]
    shuffled = rows + rng.sample(rows, 30)
    rng.shuffle(shuffled)
    late = [(0, 0, "w0.0", "token", None, at(0)), (50, 1, "too late", "token", None, at(9))]
    batches = [shuffled[:40], shuffled[40:] + open_, rows, [(99, 0, None, "done", None, at(120))], late, [(98, 0, None, "done", None, at(400))]]
    got, state = played(spark, tmp_path, batches, TOKENS, lambda s: S.assembled(s, "30 minutes", "60 minutes"), "tokens")
    whole = sorted((r[0], r[1], list(r[2]), r[3]) for r in got if r[3] and r[0] < 50)
    assert whole == [(a, b, list(c), d) for a, b, c, d in want]
    assert [(r[0], r[1]) for r in got if not r[3]] == [(50, "never")]
    assert Counter(r[0] for r in got).most_common(1)[0][1] == 1
    assert state[-1] < max(state) and state[-1] <= 4  # what is left is of the last session alone


def test_citations_may_come_last(spark, tmp_path):
    batches = [[(1, 0, "a", "token", None, at(0)), (1, 1, None, "done", None, at(0)), (2, 0, "b", "token", None, at(0)), (2, 1, None, "done", None, at(0))],
               [(1, -1, None, "citations", ["[1]"], at(1))], [(3, 0, None, "done", None, at(300))], [(4, 0, None, "done", None, at(300))]]
    got, _ = played(spark, tmp_path, batches, TOKENS, lambda s: S.assembled(s, "30 minutes", "60 minutes"), "tokens")
    assert sorted((r[0], r[1], list(r[2]), r[3]) for r in got) == [(1, "a", ["[1]"], True), (2, "b", [], True)]


def test_jobs_complete_once_over_restarts(spark, tmp_path):
    schema = "job string, page int, total int, t string"
    pages = [(j, p, n, at(k)) for k, (j, n) in enumerate([("a", 3), ("b", 1), ("c", 70)]) for p in range(1, n + 1)]
    stalled = [("d", 1, 2, at(3)), ("d", None, 2, at(3)), ("e", 1, 0, at(3)), (None, 1, 1, at(3))]
    rng = random.Random(1)
    shuffled = pages + pages
    rng.shuffle(shuffled)
    batches = [shuffled[:50], shuffled[50:] + stalled, pages, [("z", 1, 1, at(300))], [("z", 1, 1, at(300))], [("y", 1, 1, at(700))]]
    got, state = played(spark, tmp_path, batches, schema, lambda s: S.completed_once(s, "job", "total", "page", "ts", "30 minutes", "60 minutes"), "pages")
    full = spark.createDataFrame(pages, schema)
    want = sorted((*r, True) for r in map(tuple, J.completed(full, "job", "total", "page").collect()))
    assert sorted(r for r in got if r[0] in "abc") == want
    assert sorted(r for r in got if not r[3]) == [("d", 1, 2, False), ("e", 1, 0, False)]
    assert Counter(r[0] for r in got) == Counter("abcdezy")
    assert state[-1] < max(state) and state[-1] <= 3


def test_status_changes_end_with_the_latest(spark, tmp_path):
    schema = "job long, status string, t string"
    log = [(1, "PENDING", at(0)), (1, "PROCESSING", at(2)), (1, "PROCESSING", at(3)), (2, "PENDING", at(1)), (1, "COMPLETED", at(5)), (2, None, at(1)), (None, "x", at(1))]
    batches = [[log[1], log[3]], [log[0], log[2], log[5], log[6]], [log[4], log[1]]]
    got, state = played(spark, tmp_path, batches, schema, lambda s: S.status_changes(s, "job", "ts", "status", "1 hour", "1 hour"), "log")
    assert sorted((r[0], r[1]) for r in got) == [(1, "COMPLETED"), (1, "PROCESSING"), (2, "PENDING")]
    latest = spark.createDataFrame(log[:5], schema)
    twin = {r[0]: r[1] for r in J.latest(latest, "job", "t", "status").collect()}
    last = {}
    for job, status, _ in sorted(got, key=lambda r: r[2]):
        last[job] = status
    assert last == twin


def test_jobs_share_the_state_of_their_bucket(spark, tmp_path):
    schema = "job long, page long, total long, t string"
    pages = [(j, p, 3, at(1)) for j in range(300) for p in range(1, 4) if (j, p) != (7, 2)]
    random.Random(3).shuffle(pages)
    batches = [pages[:400], pages[400:] + pages[:100], [(1000, 1, 1, at(300))], [(1001, 1, 1, at(301))]]
    got, state = played(spark, tmp_path, batches, schema, lambda s: S.completed_once(s, "job", "total", "page", "ts", "30 minutes", "60 minutes", buckets=4), "pages")
    assert sorted(got) == sorted([(j, 3, 3, True) for j in range(300) if j != 7] + [(7, 2, 3, False), (1000, 1, 1, True), (1001, 1, 1, True)])
    assert max(state) <= 4 * 3  # not a row for each of the 300 jobs
