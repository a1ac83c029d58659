import random
import re
from hashlib import sha256

from leafmill.llm import substring_dedup as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    words = {d: WORD.findall(t or "") for d, t in rows}
    seen, gone = {}, {d: set() for d in words}
    for d in sorted(words, key=lambda d: S.LAST if d is None else d):
        for i in range(len(words[d]) - window + 1):
            key = tuple(words[d][i : i + window])
            if key in seen:
                gone[d].update(range(i, i + window))
            seen.setdefault(key, (d, i))
    return {
        d: (len(w), len(gone[d]), sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest())
        for d, w in words.items()
    }


def rows_of(rng):
    passages = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(3000)}é" for _ in range(rng.randrange(40))) for _ in range(4)]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a " * 300), (105, "a " * 19), (None, rows[5][1]), (7000, "x")]
    return rows


def test_equals_brute_force(spark):
    rows = rows_of(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in S.digest(S.remove_repeats(docs)).collect()}
    assert got == brute(rows, 20)
    got = {r[0]: tuple(r)[1:] for r in S.digest(S.remove_repeats(docs, 5)).collect()}
    assert got == brute(rows, 5)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS tie")
    got = sorted((r[0], r[2]) for r in S.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]
    assert S.remove_repeats(docs.where("doc_id > 9")).count() == 0


def test_doubling_ends(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "a b " + shared), (2, shared + " c"), (3, "d e f")], "doc_id long, text string")
    got = {(r[0], r[1]): r[2] for r in S.longest_repeats(docs, 10).collect()}
    assert got[1, 2] == got[2, 0] == 40 and got[2, 10] == 40 and got[2, 40] == 10 and (2, 41) not in got and (3, 0) not in got
