import hashlib
import random
from collections import Counter, defaultdict

import pytest

from leafmill.llm import queries
from leafmill.llm import token_alignment as T

P = pytest.importorskip("public_tokenizers")
PATHS = tuple(map(P.path, queries.ALIGNED))
SCHEMA = "doc_id long, text string, slice long, groups string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(rows, libraries):
    """Whole texts, every pair of tokens compared by their byte ranges."""
    a, b = libraries
    octets = T._byte_level()
    docs = []
    for doc_id, text in rows:
        tokens = [[], []]
        if text:
            ids = a.encode(" " + text, add_special_tokens=False)
            one = [(i, bytes([octets[c] for c in t])) for i, t in zip(ids.ids, ids.tokens, strict=True)]
            pieces = b.encode(text, out_type=str)
            two = [(b.piece_to_id(p), bytes([int(p[3:5], 16)]) if b.is_byte(b.piece_to_id(p)) else p.replace("▁", " ").encode()) for p in pieces]
            whole = (" " + text).encode()
            if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two):
                for side, found in enumerate((one, two)):
                    at = 0
                    for i, octs in found:
                        tokens[side].append((i, at, at + len(octs)))
                        at += len(octs)
        links = [(x[0], y[0]) for x in tokens[0] for y in tokens[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in tokens[0]} & {y[2] for y in tokens[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[0]) for x in side if start < x[2] <= cut) for side in tokens))
            start = cut
        docs.append((doc_id, tokens, links, groups))
    count = Counter(pair for d in docs for pair in d[2])
    most = defaultdict(int)
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (d, len(t[0]), len(t[1]), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if t[0] else "")
        for d, t, k, g in docs
    ]


def fixture():
    rng = random.Random(8)
    odd = ["Straße", "naïve", "日本語テキスト", "👩‍👩‍👧", "x_1", "don't", "U.S.A.", "1234567", "<|endoftext|>", "<s>", "</s>", "<0x41>", "á", "​", "\x00", "\x1c", "ﬁ", "İ", "foo(bar);", "=====", "Tschüß"]
    blanks = [" ", "  ", "   ", "\n", "\n\n ", " \n", "\t", " ", "  ", "", " 　", "\r\n"]
    rows = [(k, "".join(rng.choice(odd + ["the", "alignment", "Fenster"]) + rng.choice(blanks) for _ in range(rng.randrange(1, 60)))) for k in range(120)]
    return rows + [(200, None), (201, ""), (202, " "), (203, "    "), (204, "a▁b"), (205, "▁"), (206, " lead and trail "), (207, rows[3][1]), (207, rows[3][1]), (None, rows[4][1]), (208, "x" * 3000), (209, "\n")]


def rows_of(frame):
    from pyspark.sql import functions as F

    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return sorted(map(tuple, frame.withColumn("groups", digest).collect()), key=str)


def test_whole_query_equals_brute_force(spark, libraries):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)
    assert rows_of(T.align(docs, *PATHS)) == sorted(plain(rows, libraries), key=str)


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []


def test_slices_and_stretches_change_nothing(libraries, monkeypatch):
    """The same results when texts are cut into small stretches and slices, and little is remembered."""
    rows = [r for r in fixture() if r[1]]
    want = plain(rows, libraries)
    aligner = T.Aligner(*PATHS, remembered=20)
    monkeypatch.setattr(T, "STRETCH", 9)
    for _ in range(2):
        for (_, text), line in zip(rows, want, strict=True):
            pieces = [p for some in T.stretches(text) for p in some]
            assert "".join(pieces) == f" {text}"
            entries = aligner.align(pieces)
            if line[1]:
                assert hashlib.sha256(";".join(e[0] for e in entries).encode()).hexdigest() == line[7]
            else:
                assert None in entries
    assert len(aligner._young) + len(aligner._old) < 200


def test_text_of_many_words_is_a_slice_of_its_own(libraries):
    text = "word and Wörter, " * 60_000
    row = T._slice(T.Aligner(*PATHS), [1], [text])
    import numpy as np

    n_a, n_b, _ = np.frombuffer(T._unpack(row["numbers"]), "<i8").reshape(-1, 3)[np.frombuffer(T._unpack(row["pieces"]), "<u4")].sum(0)
    assert (n_a, n_b) == (len(libraries[0].encode(" " + text, add_special_tokens=False).ids), len(libraries[1].encode(text)))
