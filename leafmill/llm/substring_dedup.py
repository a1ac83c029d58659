"""Removal of repeated passages by level-wise doubling.

Windows of a quarter of the wanted length come first, then of half of it, then whole ones. At the shorter
lengths only anchors are counted: the lowest window hash of every full window, so equal full windows always
have equal anchors. Anchors found once are dropped; only around the others are the windows of twice the length
formed, and so on until no candidate survives or the full length is reached. Windows of the full length that
also start earlier are removed. `longest_repeats` goes on doubling beyond it until no candidate survives.

Exact copies are found first by a digest, so a text that a thousand documents share is compared once.

Order: smaller doc_id first (null last), then a hash of the text, then the start. Rows with equal doc_id and
equal text are one document and get equal results. Null and empty texts have no words and keep the empty
string; very long texts are cut into windows whole; an empty table gives an empty result; only the named
columns are read, so other columns don't clash. Windows are compared by 96 bits of hash over 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _words as W
from leafmill.llm._session import LAST as LAST  # the place of a null doc_id in the order
from leafmill.llm._session import attach, document_key, original_id, written

WINDOW = 20
KEY = ["doc", "tie"]
_STEP2 = 0xC2B2AE3D27D4EB4F


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc and tie identify a document and give its place in the order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), *document_key(F.col(doc_id), F.col(text)), whole.alias("text"))


def _near(w: W.Words, batch: pa.RecordBatch, start: int, size: int, window: int) -> np.ndarray:
    """Which words start a full window around one of the surviving anchors `ats` of `size` words."""
    n = len(w.starts)
    whole = np.zeros(n, bool)
    whole[w.whole(window)] = True
    ats = batch.column("ats").slice(start, len(w.counts))
    owner = np.repeat(np.arange(len(ats)), ats.value_lengths().to_numpy(zero_copy_only=False))
    anchors = w.first[owner] + ats.flatten().to_numpy()
    edge = np.zeros(n + window + 1, np.int64)
    np.add.at(edge, np.maximum(anchors + size - window, w.first[owner]), 1)
    np.add.at(edge, anchors + 1, -1)
    return (np.cumsum(edge)[:n] > 0) & whole


def _anchor_rows(size: int, window: int, before: int | None):
    """(hash, doc, tie, at, several) of each anchor: the window of `size` words that starts at word `at`.

    After the first level only full windows around surviving anchors of `before` words have anchors.
    """
    span = window - size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in W.pieces(batch.column("text")):
                w = W.Words(part)
                grams = W.mix(W.windows(w.hashes(), size))
                wanted = None if before is None else _near(w, batch, start, before, window)
                found = []
                for first, n in zip(w.first, w.counts, strict=True):
                    if n < window:
                        continue
                    h = grams[first : first + n - size + 1]
                    low = W.lowest(h, span)  # of each full window
                    if wanted is not None:
                        low = np.where(wanted[first : first + len(low)], low, np.uint64(0))
                    edge = np.zeros(span - 1, np.uint64)
                    reached = W.highest(np.concatenate([edge, low, edge]), span)
                    found.append(first + np.flatnonzero(h == reached))
                at = np.concatenate(found) if found else np.zeros(0, np.int64)
                owner, h = w.text[at], grams[at]
                order = np.lexsort((h, owner))
                same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                several = np.zeros(len(at), bool)
                several[order[1:][same]] = several[order[:-1][same]] = True
                row = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column("doc").take(row), batch.column("tie").take(row),
                     pa.array((at - w.first[owner]).astype(np.int32)), pa.array(several)],
                    names=["hash", "doc", "tie", "at", "several"],
                )

    return run


def _window_rows(size: int, window: int):
    """From texts with repeated anchors `ats`: (high, low, doc, tie, at) of the full windows that span one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in W.pieces(batch.column("text")):
                w = W.Words(part)
                hashes = w.hashes()
                at = np.flatnonzero(_near(w, batch, start, size, window))
                high = W.windows(hashes, window)[at]
                low = W.windows(W.mix(hashes), window, _STEP2)[at]
                row = pa.array(w.text[at] + start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.mix(high).view(np.int64)), pa.array((W.mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     batch.column("doc").take(row), batch.column("tie").take(row), pa.array((at - w.first[w.text[at]]).astype(np.int32))],
                    names=["high", "low", "doc", "tie", "at"],
                )

    return run


def _cut(window: int):
    """n_words, n_removed and the kept words of each text, given the starts of removed windows or `copy`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed_of, kept_of, words_of = [], [], []
            for start, part in W.pieces(batch.column("text")):
                w = W.Words(part)
                ats = batch.column("ats").slice(start, len(part)).to_pylist()
                copies = batch.column("copy").slice(start, len(part)).to_pylist()
                data = w.data.tobytes()
                for k, (first, n) in enumerate(zip(w.first.tolist(), w.counts.tolist(), strict=True)):
                    gone = np.zeros(n + 1, np.int64)
                    if copies[k] and n >= window:
                        gone[0] += 1
                    elif ats[k]:
                        at = np.array(ats[k])
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    kept = np.flatnonzero(np.cumsum(gone)[:n] <= 0) + first
                    words = [data[a:b] for a, b in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)]
                    words_of.append(n)
                    removed_of.append(n - len(kept))
                    kept_of.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(removed_of, pa.int64()), pa.array(kept_of, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def levels(window: int) -> list[int]:
    """The lengths before the full one: a quarter and a half of it."""
    return sorted({max(1, window // 4), max(1, window // 2)})


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The copies (doc, tie) of earlier texts, and (high, low, doc, tie, at) of all windows of the other
    documents that occur at least twice or may do so."""
    digests = written(docs.select(*KEY, F.md5("text").alias("digest")), "digests")
    place = F.struct("doc", "tie")
    first = digests.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = attach(digests, written(first, "texts"), ["digest"], "inner").where(place > F.col("first"))
    copies = written(copies.select(*KEY).distinct(), "copies")
    texts = attach(docs.select(*KEY, "text"), copies, KEY, "left_anti")

    rows, before = texts, None
    for size in levels(window):
        anchors = rows.mapInArrow(_anchor_rows(size, window, before), "hash long, doc long, tie long, at int, several boolean")
        counted = anchors.groupBy("hash").agg(
            F.min("doc").alias("d"), F.max("doc").alias("e"), F.min("tie").alias("t"), F.max("tie").alias("u"), F.max("several").alias("several")
        )
        again = written(counted.where("several OR d < e OR t < u").select("hash"), "anchors")
        survivors = anchors.select("hash", *KEY, "at").join(again.hint("merge"), "hash", "left_semi")
        survivors = written(survivors.groupBy(*KEY).agg(F.collect_list("at").alias("ats")), "survivors")
        rows, before = attach(texts, survivors, KEY, "inner").select(*KEY, "text", "ats"), size
        if survivors.isEmpty():
            break
    return copies, rows.mapInArrow(_window_rows(before, window), "high long, low int, doc long, tie long, at int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of `window` words that covers it has an equal window that starts earlier.
    """
    docs = _keyed(docs, doc_id, text)
    copies, found = repeated_windows(docs, window)
    found = written(found, "windows")
    place = F.struct(*KEY, "at")
    firsts = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(written(firsts, "firsts").hint("merge"), ["high", "low"]).where(place > F.col("first"))
    later = later.groupBy(*KEY).agg(F.collect_set("at").alias("ats"), F.lit(False).alias("copy"))
    marks = later.unionByName(copies.select(*KEY, F.array().cast("array<int>").alias("ats"), F.lit(True).alias("copy")))
    marked = attach(docs, written(marks, "marks"), KEY, "left")
    return marked.select("doc_id", "text", "ats", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept_text string"
    )


def longest_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every window start that repeats: (doc_id, at, n_words), n_words being the longest of window,
    2 * window, 4 * window, ... at which it still repeats. Levels end when no candidate survives."""
    docs = _keyed(docs, doc_id, text)
    out, length, survivors = None, window, None
    while True:
        rows = docs.select(*KEY, "text") if survivors is None else attach(docs.select(*KEY, "text"), survivors, KEY, "inner")
        if survivors is None:
            rows = rows.withColumn("ats", F.sequence(F.lit(0), F.size(F.split("text", r"[ \t-\r]+"))))
        found = written(rows.mapInArrow(_window_rows(length, length), "high long, low int, doc long, tie long, at int").distinct(), "level")
        many = found.groupBy("high", "low").count().where("count > 1").select("high", "low")
        level = written(found.join(many, ["high", "low"], "left_semi").select(*KEY, "at"), "repeats")
        if level.isEmpty():
            break
        here = level.select(*KEY, "at", F.lit(length).alias("n_words"))
        out = here if out is None else out.unionByName(here)
        survivors = written(level.groupBy(*KEY).agg(F.collect_list("at").alias("ats")), "survivors")
        length *= 2
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, at int, n_words int")
    longest = out.groupBy(*KEY, "at").agg(F.max("n_words").alias("n_words"))
    return longest.select(original_id(F.col("doc"), F.col("tie")).alias("doc_id"), "at", "n_words")


def digest(kept: DataFrame) -> DataFrame:
    """kept_text replaced by its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
