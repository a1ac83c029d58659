"""Language identification with one bit-sliced Bloom filter.

Every slot of the filter holds a mask with one bit per language, so the AND of the slots of an n-gram is the
set of all languages that have it. For each text the set bits are counted per language, less the share that
false positives explain, and the language with the highest corrected count wins. Languages beyond the first
64 have further masks.

Fitting reads texts and languages of at most about SAMPLE texts per language (chosen by a hash of the
identifier); the filter has a fixed size and is broadcast.

Defined results: `und` and score 0 for null texts and texts without a letter; a text with letters but no
known n-gram gets the commonest training language with score 1 / number of languages; `und` throughout if
no row can be learned from. Ties go to the language that sorts first. Very long texts are scored whole; repeated
rows get equal rows and each counts in training; an empty table gives an empty result; only the named columns
are read, so other columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _words as W

GRAM = 4  # bytes
SAMPLE = 3000  # texts per language to learn from, about
MOST_BROADCAST = 100_000  # languages
LEAST_COUNT = 5
LEAST_SHARE = 0.15  # of the n-gram's rate in the language where it is commonest
SLOTS = 1 << 20
HASHES = 3
MASK = 64  # languages
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All byte n-grams of letters and gaps, and the text of each."""
    data, offsets = W.string_buffers(texts)
    folded = _FOLD[data].astype(np.uint32)
    if len(folded) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    packed = folded[: 1 - GRAM].copy()
    for k in range(1, GRAM):
        packed |= folded[k : len(folded) - GRAM + 1 + k] << np.uint32(8 * k)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(packed)]
    inside = np.arange(len(packed)) + GRAM <= offsets[text + 1]
    inside &= packed != 0x20202020
    return packed[inside], text[inside]


@dataclass
class MaskFilter:
    """A Bloom filter whose slots are language masks."""

    languages: list[str]
    slots: list[np.ndarray]  # of up to MASK languages each
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], size: int = SLOTS) -> MaskFilter:
        slots, fill = [], []
        for start in range(0, len(languages), MASK):
            group = members[start : start + MASK]
            bits = max(8, 1 << (len(group) - 1).bit_length())
            part = np.zeros(size, np.dtype(f"u{bits // 8}"))
            for k, found in enumerate(group):
                for at in cls._places(found, size):
                    part[at] |= part.dtype.type(1 << k)
            slots.append(part)
            fill += [np.count_nonzero(part >> k & 1) / size for k in range(len(group))]
        return cls(languages, slots, np.array(fill) ** HASHES)

    @staticmethod
    def _places(found: np.ndarray, size: int) -> Iterator[np.ndarray]:
        h = W.mix(found.astype(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, found: np.ndarray) -> list[np.ndarray]:
        """The languages that have each n-gram, as one mask for each group of MASK languages."""
        out = []
        for part in self.slots:
            places = self._places(found, len(part))
            mask = part[next(places)]
            for at in places:
                mask &= part[at]
            out.append(mask)
        return out

    def corrected(self, texts: pa.Array) -> np.ndarray:
        """For each text and language: n-grams in the filter, less what false positives explain."""
        found, text = grams(texts)
        masks, n = self.masks(found), np.bincount(text, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        for k, rate in enumerate(self.false_rate):
            mask = masks[k // MASK]
            hits = np.bincount(text, weights=(mask >> mask.dtype.type(k % MASK)) & mask.dtype.type(1), minlength=len(texts))
            out[:, k] = np.maximum(0, (hits - n * rate) / (1 - rate))
        return out


def has_letter(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script."""
    data, offsets = W.string_buffers(texts)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[data], out=sums[1:])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 1)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, part in W.pieces(batch.column("text")):
            languages = np.array(batch.column("lang").slice(start, len(part)).to_pylist(), object)
            found, text = grams(part)
            for name in sorted(set(languages)):
                values, n = np.unique(found[(languages == name)[text]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(values), "gram": values.astype(np.int64), "n": n})


def fit(train: DataFrame, per_language: int = SAMPLE) -> tuple[MaskFilter, int]:
    """From rows (doc_id, text, lang): the filter and the index of the commonest language."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    totals = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row per language
    if not totals:
        return MaskFilter.build([], []), 0
    languages = sorted(totals)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) / 1e6
    shares = train.sparkSession.createDataFrame([(name, min(1.0, per_language / n)) for name, n in totals.items()], "lang string, share double")
    sample = train.join(shares.hint("broadcast" if len(totals) <= MOST_BROADCAST else "merge"), "lang").where(part < F.col("share")).select("text", "lang")
    counted = sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.where(F.col("n") >= LEAST_COUNT).toPandas()  # bounded by the sample
    sums = table.groupby("lang")["n"].sum()
    table["rate"] = table["n"] / table["lang"].map(sums)
    table = table[table["rate"] >= LEAST_SHARE * table.groupby("gram")["rate"].transform("max")]
    members = [table.loc[table["lang"] == name, "gram"].to_numpy(np.uint32) for name in languages]
    return MaskFilter.build(languages, members), max(range(len(languages)), key=lambda k: (totals[languages[k]], -k))


def predict(docs: DataFrame, model: MaskFilter, usual: int) -> DataFrame:
    """(doc_id, text) rows to doc_id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model, usual))

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, usual = shared.value
        for texts in batches:
            names, scores = [], []
            for _, part in W.pieces(texts):
                known = has_letter(part) & bool(model.languages)
                if model.languages:
                    counts = model.corrected(part)
                    total = counts.sum(1)
                    best = np.where(total > 0, counts.argmax(1), usual)
                    score = np.where(total > 0, counts.max(1) / np.maximum(total, 1e-9), 1 / len(model.languages))
                    names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    scores.append(np.where(known, score, 0.0))
                else:
                    names += [UNKNOWN] * len(part)
                    scores.append(np.zeros(len(part)))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], names=["lang_pred", "score"])

    guessed = F.arrow_udf(guess, "lang_pred string, score double", functionType=F.ArrowUDFType.SCALAR_ITER)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guessed("text").alias("r"))
    return rows.select("doc_id", "held_out", "r.lang_pred", "r.score")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model, usual = fit(rows.where(~held_out(F.col("doc_id"))))
    return predict(rows.select("doc_id", "text"), model, usual)
