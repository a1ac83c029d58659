import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from leafmill.llm import _words as W
from leafmill.llm import minhash_dedup as M


def words(text):
    return (W.Words(pa.array([text])).hashes() >> np.uint64(32)).astype("<u4")


def common(x, y):
    """Length of the longest order-keeping alignment, by a plain dynamic program."""
    row = [0] * (len(y) + 1)
    for p in x:
        last, row = row, [0]
        for j, q in enumerate(y):
            row.append(last[j] + 1 if p == q else max(last[j + 1], row[j]))
    return row[-1]


def brute(rows):
    """Classes by comparing every pair of texts word by word."""
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    found = {d: (t or "").split() for d, t in rows}
    for (a, x), (b, y) in itertools.combinations(found.items(), 2):
        if not x or not y or len(set(x) & set(y)) < 0.3 * max(len(set(x)), len(set(y))):
            continue
        c = common(x, y)
        if c >= M.SIMILARITY * (len(x) + len(y) - c):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: root(d) for d in parent}


def near_copies(rng, n_groups=12):
    rows, d = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = [w if rng.random() > 0.01 * rng.randrange(4) else f"x{rng.randrange(9999)}" for w in base]
            rows.append((d, " ".join(copy)))
            d += 1
    return rows + [(500, None), (501, ""), (502, "a b c"), (503, "a b c"), (504, rows[3][1]), (505, rows[3][1]), (506, " \n")]


def test_classes_equal_brute_force(spark):
    rows = near_copies(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_alignment_keeps_order():
    a = np.arange(100, dtype=np.uint32)
    assert M.similarity(a, a) == 1.0
    assert M.similarity(a, np.concatenate([a[50:], a[:50]])) == 0.0
    assert 0.8 <= M.similarity(a, a[:85]) < 1.0
    assert M.similarity(a[:0], a) == 0.0


def test_alignment_equals_a_plain_dynamic_program():
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randrange(1, 70))]
        b = [x if rng.random() > 0.08 else rng.randrange(60) for x in a if rng.random() > 0.05]
        b[rng.randrange(len(b) + 1) : 0] = [1] * rng.randrange(4)
        c = common(a, b)
        want = c / (len(a) + len(b) - c)
        assert M.similarity(np.array(a, "<u4"), np.array(b, "<u4")) == (want if want >= M.SIMILARITY else 0.0)


def test_one_changed_word_is_a_near_copy(spark):
    rng, rows = random.Random(3), []
    for n in [20, 40, 60] * 25:
        base = [f"w{rng.randrange(9999)}" for _ in range(n)]
        copy = list(base)
        copy[rng.randrange(n)] = "changed"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] == got[d + 1] for d in range(0, len(rows), 2)) == 75


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r["node"]: r["label"] for r in M.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


def test_keep_first_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "z")], "doc_id long, text string").selectExpr("*", "1 AS node")
    assert sorted(r["doc_id"] for r in M.keep_first(docs).collect()) == [1, 3]
    assert M.keep_first(docs.where("doc_id > 9")).count() == 0


def test_one_equal_sketch_outside_a_star_is_enough(spark):
    """Three texts of a bucket in three classes: the similar pair shares no other sketch."""
    texts = [np.arange(40), np.arange(3, 43), np.arange(100, 140)]
    rows = [((d, 0), len(t), [7, *range(100 * d, 100 * d + M.SKETCHES - 1)], t.astype("<u4").tobytes()) for d, t in enumerate(texts)]
    rows = spark.createDataFrame(rows, "node struct<doc:bigint,tie:bigint>, n int, sketches array<int>, words binary")
    known = rows.selectExpr("0 AS band", "7 AS value", "node", "n", "node AS label")
    assert [(r["a"]["doc"], r["b"]["doc"]) for r in M._apart(known, rows).collect()] == [(1, 0)]


def test_short_texts_are_found_exactly(spark):
    """Texts of few words and the same texts with some words more at either end."""
    rng, rows = random.Random(9), []
    for n in [7, 8, 8, 8, 9, 9, 10, 11, 12, 13, 14, 16, 20, 24, 28] * 4:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        more = max(1, (n - 4) // 4)
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate([base, [*base, *"abcdef"[:more]], [*"ghijkl"[:more], *base], base[1:]])]
    rows += [(5000 + k, f"one two three four five six seven end{k}") for k in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_divided_buckets_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(d, f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(60))} {passage}") for d in range(60)]
    for d in range(60, 90):
        words = rows[d % 7][1].split()
        words[rng.randrange(60)] = words[rng.randrange(60)] = f"x{d}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(M, "LARGE", 3)
    assert {r["doc_id"]: r["class_id"] for r in M.near_duplicates(docs).collect()} == brute(rows)


def test_sliding_band_equals_whole_alignment():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, rng.integers(2, 300), rng.integers(10, 400)).astype(np.uint32)
        b = a.copy()
        b[rng.random(len(b)) < 0.08] = 1
        b = np.delete(b, rng.integers(0, len(b), rng.integers(0, 9)))
        need = int(np.ceil(0.8 * (len(a) + len(b)) / 1.8 - 1e-9))
        if min(len(a), len(b)) >= need:
            whole = M._aligned_whole(a, b, need)
            assert M._aligned_sliding(a, b, need) == whole


def test_texts_of_100000_words_are_aligned_in_bounded_memory():
    rng = np.random.default_rng(1)
    a = np.minimum(rng.zipf(1.2, 100_000), 2**31).astype(np.uint32)
    b = a.copy()
    b[::30] = 5
    tracemalloc.start()
    found = M.similarity(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.9 < found < 0.97 and peak < 100e6
