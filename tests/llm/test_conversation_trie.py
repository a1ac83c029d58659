import hashlib
import random
import zlib
from collections import defaultdict

from leafmill.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            spoken = role or "", text or ""
            tie = hashlib.md5(f"{len(spoken[0].encode())}:{spoken[0]}{spoken[1]}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, spoken))
    turns = {c: [t[3] for t in sorted(found)] for c, found in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    return out


def plain_trie(convs):
    """Nodes by whole prefixes, totals by looking at every pair of nodes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for k, found in members.items():
        below = [x for x in members if x[: len(k)] == k]
        children = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in found if len(convs[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(found), len(k), parent, len(found), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return C.prefix_trie(*C.with_openings(C.numbered(frame)))


def fixture():
    rng = random.Random(4)
    rows = []
    for c in [*range(30), 100, 101, 105, 250, 251, 399, 1203]:
        for t in range(rng.choice([1, 1, 2, 3, 7, 8, 9, 20])):
            rows.append((c, t * 10, rng.choice(["user", "assistant", None]), rng.choice(["hi", "Größe 👍", "", None, "go on"])))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 0, "user", "tie"), (8, 0, "user", "also"), (None, 1, "user", "nobody's"), (rows[0])]
    for c in range(700, 740):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(5)]
    return rows


def test_whole_query_equals_brute_force(spark):
    rows = fixture()
    result = built(spark, rows)
    assert result.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in result.collect()), key=str) == plain_trie(plain_rebuilt(rows))


def test_tries_of_each_depth_around_the_cuts(spark):
    for depth in (1, 2, 3, 4, 5, 16, 17):
        convs = {c: [("user", f"{t if t % 3 or c % 2 else c}") for t in range(depth - c % 2)] for c in range(6)}
        rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
        frame = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
        names = spark.createDataFrame([(c,) for c in convs], "conv_id long")
        got = C.prefix_trie(C.numbered(frame), names)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(convs)


def test_empty_table_and_conversations_without_turns(spark):
    assert built(spark, []).collect() == []
    none = C.numbered(spark.createDataFrame([], SCHEMA))
    names = spark.createDataFrame([(5,), (3,)], "conv_id long")
    assert [tuple(r) for r in C.prefix_trie(none, names).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_one_conversation_of_many_turns_spreads_over_tasks(spark):
    n = 20_000
    frame = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    rows = C.prefix_trie(C.numbered(frame), spark.createDataFrame([(1,), (2,)], "conv_id long")).orderBy("depth").collect()
    assert len(rows) == n + 1 and [r["depth"] for r in rows] == list(range(n + 1))
    assert rows[0]["n_convs"] == 2 and {r["n_leaves"] for r in rows} == {1} and {r["saved_tokens"] for r in rows} == {0}
