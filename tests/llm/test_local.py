"""Pieces that run inside tasks, against plain loops; no Spark job."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import _words as W
from leafmill.llm import language_id, quality_rules, token_counts, token_output, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_texts(rng, n=400):
    alphabet = "abehtr inTHE \n\t▁é😀．'.,&<|>0123éß̈́Σ\xa0\x1c　"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]
    return made + ["", " ", "<|endoftext|>", "ab<|endoftext|>c", "it's they're 'stat", "é é", "x" * 3000, "a b " * 500, "日本語 text", "İstanbul ΑΣ ΑΣ."]


def test_token_counts_equal_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PieceCounter(token_counts.load_ranks(path), remembered=500)
    for text in odd_texts(random.Random(3)):
        assert counter(text) == len(library.encode(text)), text
    assert counter(None) == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_output.Encoder(path, remembered=3000)
    rng = random.Random(5)
    letters = [chr(c) for c in range(0xC0, 0x280)] + list("aZ\u0301\u0345ßΣ日")
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha()]
    near = [f"{x}{c}{m}{y}" for c in letters for m in marks for x, y in [rng.choice([("", ""), ("a", "b"), ("É", ""), ("", c)])]]
    made = ["".join(rng.choice(letters + marks + list("abc ")) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts = [t for t in odd_texts(rng) + near + made] + [None]
    for start, part in W.pieces(pa.array(texts), 4000):
        ids, sizes = encoder.encode(part)
        ends = np.cumsum(sizes)
        for text, a, b in zip(part.to_pylist(), ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids + [1], (start, text)


def test_perfect_hash_is_minimal_and_turns_others_away():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    h = token_output.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    lengths = np.arange(len(keys)) % 5 + 1
    shard = token_output.Index(token_output._shard(keys.tolist(), np.zeros(lengths.sum(), "<u2").tobytes(), lengths, 2))
    at, n = shard.find(keys)
    assert (at == np.concatenate([[0], np.cumsum(lengths)])[:-1]).all() and (n == lengths).all()
    assert (shard.find(np.arange(10**6, 10**6 + 2000))[0] == -1).mean() > 0.999
    assert len(token_output.PerfectHash.build(keys[:0]).slots(keys[:0])) == 0


def test_statistics_equal_plain_loops():
    rng = random.Random(7)
    texts = [rng.choice([" ", "\n"]).join(rng.choice(["ab", "c#", "é|", "Dé.", "x"]) for _ in range(rng.randrange(60))) for _ in range(80)] + ["", "\n\n a\n a\n", None]
    got = quality_rules.slice_stats(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {j + k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(set(w)))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want


def test_em_finds_the_rules_that_tell():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    votes = np.ones((len(truth), len(quality_rules.RULES)), int)
    for k in range(votes.shape[1]):
        right = rng.random(len(truth)) < (0.95 if k < 3 else 0.6)
        votes[:, k] = np.where(rng.random(len(truth)) < 0.2, 1, np.where(right == truth, 2, 0))
    patterns, counts = np.unique(votes @ 3 ** np.arange(votes.shape[1]), return_counts=True)
    p = quality_rules.estimate(patterns, counts)
    kept = p[np.searchsorted(patterns, votes @ 3 ** np.arange(votes.shape[1]))] >= 0.5
    assert (kept == truth).mean() > 0.93


def test_masks_have_every_member_and_few_others():
    members = [np.arange(0, 5000, dtype=np.uint32), np.arange(4000, 9000, dtype=np.uint32)]
    model = language_id.MaskFilter.build(["a", "b"], members, 1 << 16)
    masks = model.masks(np.arange(9000, dtype=np.uint32))[0]
    assert (masks[:5000] & 1).all() and (masks[4000:] & 2).all()
    others = model.masks(np.arange(10**6, 10**6 + 50_000, dtype=np.uint32))[0]
    assert (masks[5000:] & 1).mean() < 0.05 and abs((others & 1).mean() - model.false_rate[0]) < 0.01
    many = language_id.MaskFilter.build([f"l{k:03}" for k in range(150)], [np.arange(50 * k, 50 * k + 50, dtype=np.uint32) for k in range(150)], 1 << 16)
    for k in (0, 63, 64, 149):
        mask = many.masks(np.arange(50 * k, 50 * k + 50, dtype=np.uint32))
        assert (mask[k // 64] >> mask[k // 64].dtype.type(k % 64) & 1).all() and len(mask) == 3
    assert language_id.has_letter(pa.array(["1 2", "é", "", None, "a", "日"])).tolist() == [False, True, False, False, True, True]


def test_distances_tell_the_dictionaries_apart():
    rng = random.Random(2)
    plain = [f" {rng.choice('bcdfg')}{rng.choice('aeiou')}rd {rng.choice('klmnp')}{rng.choice('aeiou')}st ".encode() for _ in range(3000)]
    common = toxicity.trained(plain, 2048)
    bad = toxicity.trained([rng.choice([b" wretchedness ", b" no good 5511 "]) for _ in range(50)], 512)
    d = toxicity.Distance(common, common + bad)
    found = d.features(["such wretchedness bard kest", "bard kest bird most", "good 5511 1 2", None, " ", "a" * 200_000])
    assert found[0][0] >= 6 > found[1][0] and found[2][0] >= 3  # phrases and digits tell as words do
    assert not found[3].any() and not found[4].any() and len(d._seen) < toxicity.REMEMBERED
    assert toxicity.windows("A b\nC d") == [b" a b ", b" b c ", b" c d ", b" d "]


@pytest.mark.parametrize("size", [3, 7, 100_000])
def test_features_equal_plain_loops_over_windows(monkeypatch, size):
    monkeypatch.setattr(toxicity, "SLICE", size)
    rng = random.Random(5)
    vocabulary = ["bard", "kest", "wretchedness", "wretch", "no", "good", "5511", "é", "x" * 40]
    texts = [" \n".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", " \t", "no", "x"]
    common = b" bard kest good no bard most kest "
    d = toxicity.Distance(common, common + b" wretchedness no good 5511 ")
    added = set(toxicity.grams(b" wretchedness no good 5511 ").tolist())
    got = d.features(texts)
    assert len(got) == len(texts)
    for row, text in zip(got, texts, strict=True):
        found = toxicity.windows(text)
        plain = sorted((max(0, d._distances([w])[0]) if added & set(toxicity.grams(w).tolist()) else 0 for w in found), reverse=True)
        over = np.array([sum(x >= cut for x in plain) for cut in toxicity.CUTS])
        best = [min(x, toxicity.TOP) for x in (plain + [0, 0])[:2]]
        assert np.allclose(row, [*best, np.log1p(len(found)), *np.log1p(over), *np.sqrt(over / max(1, len(found)))])
    assert got[:, 0].max() >= 6


def test_pieces_keep_whole_texts():
    array = pa.array(["a" * 10, None, "", "b" * 50, "c"]).slice(1)
    assert [(s, p.to_pylist()) for s, p in W.pieces(array, 20)] == [(0, [None, ""]), (2, ["b" * 50]), (3, ["c"])]


def test_language_counts_equal_sets_of_grams():
    """Without collisions in the filter the counts are those of plain sets, and the largest one wins."""
    texts = {"en": ["The other thing", "there with"], "fr": ["était leçon", "près voilà été"], "de": ["über die straße", "ÜBER den"]}
    cut = lambda t: [bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in t.encode())[i : i + 4] for i in range(len(t.encode()) - 3)]
    number = lambda g: int.from_bytes(g, "little")
    names = sorted(texts)
    members = [{g for t in texts[n] for g in cut(t) if g != b"    "} for n in names]
    model = language_id.MaskFilter.build(names, [np.array(sorted(map(number, m)), np.uint32) for m in members])
    asked = ["the thing is there", "voilà une leçon", "die Straße", "12 34", "", "TH"]
    counts = model.corrected(pa.array(asked))
    for row, text in zip(counts, asked, strict=True):
        want = [sum(g in m for g in cut(text)) for m in members]
        assert np.abs(row - want).max() < 0.01
