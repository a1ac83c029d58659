import itertools
import random

import numpy as np
import xxhash

from leafmill.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, fingerprint string, fp long"


def plain_print(text):
    """Bit by bit over all shingles."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id over links between all pairs."""
    label = [d for d, _ in rows]
    prints = [plain_print(t) for _, t in rows]
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                known = [x for x in (label[i], label[j]) if x is not None]
                label[i] = label[j] = min(known)
                changed = True
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, label, strict=True)), key=str)


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Größe", "été", "a b", "👍"]
    rows = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))]
        rows.append((d * 3, " ".join(words)))
        for e in range(rng.randrange(3)):  # near copies, with other blanks and cases
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            rows.append((1000 - d * 3 - e, "\n\t ".join(near).upper()))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE  two"), (505, "one two"), (506, rows[0][1]), (506, rows[0][1]), (None, rows[1][1]), (None, "alone here now")]


def test_whole_query_equals_brute_force(spark, monkeypatch):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    want = plain_components(rows)
    result = S.simhash_components(docs)
    assert result.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in result.collect()), key=str) == want
    monkeypatch.setattr(S, "LARGE", 1)  # every posting is posted anew under six bytes
    assert sorted((tuple(r) for r in S.simhash_components(docs).collect()), key=str) == want


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fingerprints_of_long_texts_in_slices(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["Ab", "c", "dé", "efg hij"]) for _ in range(3_000))
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(S, "SLICE", size)
        assert S.fingerprint(text.encode()) == plain_print(text)
        assert S.fingerprint(b"  one   TWO ") == plain_print("one two") and S.fingerprint(b"") == S.fingerprint(b"  ") == 0
    assert S.fingerprint("x y z ".encode() * 300_000) == plain_print("x y z " * 300_000)


def plain_links(prints):
    return {(max(a, b), min(a, b)) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2}


def classes(pairs):
    label = {}
    for a, b in pairs:
        x, y = label.get(a, {a}), label.get(b, {b})
        joined = x | y
        for node in joined:
            label[node] = joined
    return {frozenset(c) for c in label.values()}


def test_long_lists_are_looked_up_and_short_ones_tallied():
    rng = np.random.default_rng(1)
    prints = np.unique((rng.integers(0, 1 << 11, 700, dtype=np.uint64) << np.uint64(53)) | np.uint64(12345))
    looked = S._looked_up(prints)
    tallied = S._tallied(prints, np.full(len(prints), len(prints)))
    want = classes(plain_links(prints.tolist()))
    assert classes(zip(*map(np.ndarray.tolist, looked), strict=True)) == classes(zip(*map(np.ndarray.tolist, tallied), strict=True)) == want


def test_one_large_group_of_near_copies(spark):
    """Thousands of different fingerprints in one posting: fewer links than members of each posting."""
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 13, 4_000, dtype=np.uint64) | np.uint64(0xABC << 40)).view(np.int64)
    table = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    links = [tuple(r) for r in S.links(table).collect()]
    assert len(links) < 34 * len(prints)
    want = classes(plain_links(prints.tolist()[:600]))
    found = classes(links)
    assert all(any(c <= f for f in found) for c in want)
