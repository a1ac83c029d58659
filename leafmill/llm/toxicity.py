"""Toxicity by compression distance.

Two zstandard dictionaries are trained with its dictionary builder, one on toxic and one on ordinary text. The
ordinary one is trained on windows of ordinary texts. The toxic one is the same content followed by what the
builder finds in samples of toxic text: of each toxic text the words whose document frequency is higher among
toxic texts than chance explains (a likelihood ratio) and over LIFT times that among ordinary ones. Without the
latter, many rows make frequent words significant that differ little, as where toxic texts are longer or of one
language; they fill the samples, and what is toxic finds no place. Text that both classes share is so compressed alike by
both, and the distance of a window (WINDOW words, one window from each word on), its compressed length under the
ordinary dictionary less that under the toxic one, comes from toxic passages: words, parts of words, phrases, digits, in
any script. A window that shares no run of GRAM bytes (the builder's own unit) with what the toxic dictionary adds has
distance 0 and is not compressed; runs are looked up as hashes of GRAM_BITS bits.

A calibrated logistic model over a text's window distances (the largest ones, and how many windows reach each
of the thresholds in CUTS) gives the score.

Labels are learned from at most about SAMPLE labelled rows (chosen by a hash of the identifier); equal texts
among them count once. Words are counted and distances measured on the executors. Only MAX_WORDS words, one
sample of at most MAX_TEXT bytes for each toxic text, about WINDOWS windows and one row of numbers for each
sampled text reach the driver.

Defined results: null and empty texts are scored as texts without windows; very long texts are scored whole;
with one class or none to learn from, every score is the share of toxic labels (0 if there are none); repeated
rows get equal rows; of several labels of one doc_id the highest counts; an empty table gives an empty result;
only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _words as W
from leafmill.llm._session import written
from leafmill.llm.language_id import held_out

SAMPLE = 20_000
WINDOW = 2  # words
WINDOWS = 60_000
WORD_BYTES = 6  # about, with the blank
MAX_WORDS = 4_000
MAX_TEXT = 500  # bytes
LEAST_RATIO = 12.0  # of twice the log likelihood
LIFT = 12.0
COMMON_BYTES, TOXIC_BYTES = 65_536, 4_096
MIN_TRAIN = 8  # samples; the builder needs some
SEGMENT, GRAM = 16, 6  # bytes: what the builder picks, and the runs that it counts
GRAM_BITS = 20
SLICE = 100_000  # words
LEVEL, MIN_MATCH = 12, 3
THRESHOLD = 0.3
CUTS = (3, 4, 5, 6, 7, 8, 10)
TOP = 14.0
REMEMBERED = 100_000
#: zstandard looks for matches only up to some bytes before the end; both dictionaries treat these alike.
PAD = b"\n" * 12
N_FEATURES = 3 + 2 * len(CUTS)


def _single(text: str | None) -> list[bytes]:
    """The words of a text in lower case."""
    return text.lower().encode(errors="replace").split() if text else []


def windows(text: str | None) -> list[bytes]:
    """The text in lower case as windows of WINDOW words, one from each word on; the last ones are shorter."""
    words = _single(text)
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(len(words))]


def grams(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    flat = np.frombuffer(data, np.uint8)
    n = len(flat) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for i in range(GRAM):
        packed = packed << np.uint64(8) | flat[i : i + n]
    return (packed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains; of few samples, the samples themselves."""
    import zstandard

    whole = b"".join(samples)[-size:]
    if len(samples) < MIN_TRAIN or len(whole) < size // 4:
        return whole
    try:
        made = zstandard.train_dictionary(min(size, len(b"".join(samples))), samples, d=GRAM, k=SEGMENT, f=20, split_point=1.0, accel=1).as_bytes()
    except zstandard.ZstdError:  # too little in the samples
        return whole
    # the content follows the entropy tables, which end in the three fixed first offsets
    tables = made.find(b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00")
    return made[tables + 12 :] if tables >= 0 else made


class Distance:
    """Window distances of whole texts; remembers those of windows. The toxic dictionary starts with the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self._sides = [self._compressor(ordinary), self._compressor(toxic)]
        self._added = np.zeros(1 << GRAM_BITS, bool)
        self._added[grams(toxic[len(ordinary) :])] = True
        self._seen: dict[bytes, int] = {}

    @staticmethod
    def _compressor(data: bytes):
        import zstandard

        data = data.rjust(8, b" ")  # the least that is a dictionary
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(data), source_size=64, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def _slices(self, texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """About SLICE words at a time: their bytes, and the text, start and end of each window in them."""
        parts, owners, counts, words = [], [], [], []
        size = 0
        for k, text in enumerate(texts):
            found = _single(text)
            for at in range(0, len(found), SLICE):
                part = found[at : at + SLICE + WINDOW - 1]  # the last windows of a slice end in the next one
                parts.append(b" " + b" ".join(part) + b" ")
                owners.append(k)
                words.append(len(part))
                counts.append(min(SLICE, len(found) - at))
                size += len(part)
                if size >= SLICE:
                    yield self._placed(parts, owners, counts, words)
                    parts, owners, counts, words, size = [], [], [], [], 0
        if parts:
            yield self._placed(parts, owners, counts, words)

    @staticmethod
    def _placed(parts: list[bytes], owners: list[int], counts: list[int], words: list[int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        data = b"".join(parts)
        blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # one before each word and one behind the last of a part
        n, words = np.array(counts), np.array(words)
        first = np.cumsum(words + 1) - (words + 1)
        index = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        behind = np.minimum(index + WINDOW, np.repeat(first + words, n))
        return data, np.repeat(np.array(owners), n), blanks[index], blanks[behind] + 1

    def _distances(self, new: list[bytes]) -> list[int]:
        padded = [w + PAD for w in new]
        ordinary, toxic = (side.multi_compress_to_buffer(padded, threads=0) for side in self._sides)
        return [len(a) - len(b) for a, b in zip(ordinary, toxic, strict=True)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row a text; equal windows are compressed once."""
        n = np.zeros(len(texts))
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data, owner, start, end in self._slices(texts):
            n += np.bincount(owner, minlength=len(texts))
            shared = np.concatenate([[0], np.cumsum(self._added[grams(data)])])
            before, behind = (np.minimum(at, len(shared) - 1) for at in (start, np.maximum(end - GRAM + 1, start)))
            met = np.flatnonzero(shared[behind] > shared[before])
            held = [data[a:b] for a, b in zip(start[met].tolist(), end[met].tolist(), strict=True)]
            new = list(dict.fromkeys(w for w in held if w not in self._seen))
            if len(self._seen) + len(new) > REMEMBERED:
                self._seen, new = {}, list(dict.fromkeys(held))
            for at in range(0, len(new), 10_000):
                part = new[at : at + 10_000]
                self._seen.update(zip(part, self._distances(part), strict=True))
            owners.append(owner[met])
            found.append(np.array([self._seen[w] for w in held], np.int64))
        owner, d = np.concatenate(owners), np.maximum(0, np.concatenate(found))
        order = np.lexsort((-d, owner))
        owner, d = owner[order], d[order]
        place = np.arange(len(d)) - np.searchsorted(owner, owner)
        best = np.zeros((len(texts), 2))
        best[owner[place < 2], place[place < 2]] = d[place < 2]
        over = np.stack([np.bincount(owner[d >= cut], minlength=len(texts)) for cut in CUTS], axis=1)
        return np.c_[np.minimum(best, TOP), np.log1p(n), np.log1p(over), np.sqrt(over / np.maximum(n, 1)[:, None])]


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights of a logistic model (the last is the constant), by penalised Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + (penalty * len(y) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * len(y) * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = sorted(set(_single(text.as_py())))
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * len(words), pa.int32()), "word": pa.array([w.decode() for w in words], pa.string())})


def _toxic_samples(known: frozenset[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text the words that are typical of toxic ones, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b" ".join(dict.fromkeys(w for w in _single(t.as_py()) if w in known))[:MAX_TEXT] for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"sample": pa.array([b" " + f + b" " for f in found if f], pa.binary())})

    return run


def _ordinary_windows(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A share of all windows that don't overlap, chosen by a hash of window and place."""
    limit = int(share * 2**32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                found = [w for i, w in enumerate(windows(t.as_py())[::WINDOW]) if zlib.crc32(w, i) < limit]
                yield pa.RecordBatch.from_pydict({"sample": pa.array(found, pa.binary())})

    return run


def dictionaries(rows: DataFrame) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from rows (text, toxic)."""
    n = {r["toxic"]: (r["n"], r["size"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if len(n) < 2:
        return b"", b""
    ordinary, toxic = float(n[0][0]), float(n[1][0])
    counted = rows.mapInArrow(_document_words, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = (F.col("a") + F.col("b")) / (ordinary + toxic)
    part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (share * of))).otherwise(0.0)
    ratio = 2 * (part("a", toxic) + part("b", ordinary))
    typical = counted.where((F.col("a") >= 2) & (F.col("a") / toxic > LIFT * F.col("b") / ordinary)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    known = frozenset(r["word"].encode() for r in typical.orderBy(F.desc("ratio"), "word").limit(MAX_WORDS).collect())
    bad = rows.where("toxic = 1").mapInArrow(_toxic_samples(known), "sample binary").collect()
    plain = rows.where("toxic = 0").mapInArrow(_ordinary_windows(min(1.0, WINDOWS * WINDOW * WORD_BYTES / max(1, n[0][1] or 0))), "sample binary").collect()
    bad, plain = (sorted((bytes(r["sample"]) for r in side), key=lambda s: (zlib.crc32(s), s)) for side in (bad, plain))  # mixed, and alike in each run
    common = trained(plain, COMMON_BYTES)
    return common, common + trained(bad, TOXIC_BYTES)


#: A worker process keeps the distances of the dictionaries that it met last.
_kept: dict[tuple[bytes, bytes], Distance] = {}


def _features(shared) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ordinary, toxic, weights = shared.value
        if (ordinary, toxic) not in _kept:
            _kept.clear()
            _kept[ordinary, toxic] = Distance(ordinary, toxic)
        distance = _kept[ordinary, toxic]
        for texts in batches:
            x = np.concatenate([distance.features(part.to_pylist()) for _, part in W.pieces(texts)] or [np.zeros((0, N_FEATURES))])
            if weights is None:
                yield pa.array(list(x), pa.list_(pa.float64()))
            else:
                yield pa.array(1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ weights, -30, 30))))

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes, np.ndarray]:
    """From (doc_id, text) and (doc_id, toxic): both dictionaries and the calibrated weights."""
    spark = docs.sparkSession
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = labels.count()
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    chosen = labels.where(part < min(1.0, sample / max(1, total)))  # about `sample` rows at most
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))
    rows = written(rows, "toxicity")
    ordinary, toxic = dictionaries(rows)
    table = rows.select("toxic", _udf(spark, (ordinary, toxic, None), "array<double>")("text").alias("x")).toPandas()
    y = table["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        weights = np.zeros(N_FEATURES + 1)
        weights[-1] = np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -30, 30)
        return ordinary, toxic, weights
    return ordinary, toxic, calibrate(np.array(table["x"].to_list()), y)


def _udf(spark, model: tuple, kind: str) -> Callable[..., Column]:
    return F.arrow_udf(_features(spark.sparkContext.broadcast(model)), kind, functionType=F.ArrowUDFType.SCALAR_ITER)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Held-out rows teach nothing."""
    docs = docs.select("doc_id", "text")
    labels = labels.select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = _udf(docs.sparkSession, model, "double")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
