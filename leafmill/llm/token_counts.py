"""Token counts of byte-pair vocabularies without emitting identifiers.

A piece starts as a linked list of symbols. A heap yields the adjacent pair whose union has the lowest
rank; the pair is merged, its neighbours form new pairs, and so on until no pair is in the vocabulary.
The count is the number of initial symbols less the number of merges. Symbols that are left over and in no
vocabulary entry count as their UTF-8 bytes (byte fallback).

Texts are cut where no vocabulary entry spans the cut, so counts of pieces add up exactly and a bounded
table of pieces seen by a worker process saves most merges.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows get equal rows; an empty
table gives an empty result; very long texts are counted whole; only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_LIMIT = 4096
#: Pieces of at most 64 characters whose counts a worker process remembers; the table starts anew when it is full.
REMEMBERED = 1_000_000
SPACE = "▁"


def load_ranks(path: str) -> dict[str, int]:
    """The rank of each entry of a sentencepiece BPE vocabulary: its place in the order of merges."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    skip = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    usable = [i for i in range(size) if not skip(i)]
    usable.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): r for r, i in enumerate(usable)}


def cutter(ranks: dict[str, int]) -> re.Pattern:
    """Cuts a text where no vocabulary entry spans the cut: before spaces and marks, around controls."""
    inner = {a + b for entry in ranks for a, b in zip(entry, entry[1:], strict=False)}
    if any(pair[1] == SPACE and pair[0] != SPACE for pair in inner):
        raise ValueError("entries of this vocabulary span the start of a word")
    alone = "".join(c for c in "\n\t\r" if not any(c in pair for pair in inner))
    tied: set[str] = set()  # marks that some entry has after a letter, or after such a mark
    while True:
        joins = lambda c: c in tied or re.fullmatch(r"\w", c)
        more = {b for a, b in inner if joins(a) and not joins(b)} - {SPACE, *alone}
        if not more:
            break
        tied |= more
    letter = rf"\w{''.join(map(re.escape, sorted(tied)))}"
    return re.compile(f"{SPACE}*[{letter}]+|{SPACE}*[^{letter}{SPACE}{alone}]+[{letter}]*|[{alone}]|{SPACE}+")


def count_piece(piece: str, ranks: dict[str, int]) -> int:
    """Tokens of one piece: initial symbols less merges."""
    n = len(piece)
    get = ranks.get
    symbols = list(piece)
    due = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts at a symbol
    due.append(-1)
    heap = [rank * n + i for i, rank in enumerate(due) if rank >= 0]
    merges = 0
    if heap:
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i = divmod(pop(heap), n)
            if due[i] != rank:  # one of the two has been merged meanwhile
                continue
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j] = ""
            due[j] = -1
            merges += 1
            after[i] = k = after[j]
            rank = -1
            if k < n:
                before[k] = i
                rank = get(symbols[i] + symbols[k], -1)
                if rank >= 0:
                    push(heap, rank * n + i)
            due[i] = rank
            h = before[i]
            if h >= 0:
                due[h] = rank = get(symbols[h] + symbols[i], -1)
                if rank >= 0:
                    push(heap, rank * n + h)
    spelled = sum([len(s.encode()) - 1 for s in symbols if s and s not in ranks])
    return n + spelled - merges


class PieceCounter:
    """Counts whole texts, remembering the counts of pieces."""

    def __init__(self, ranks: dict[str, int], remembered: int = REMEMBERED) -> None:
        self._ranks, self._cut, self._limit = ranks, cutter(ranks).findall, remembered
        self._seen: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self._seen, 0
        pieces = self._cut(SPACE + text.replace(" ", SPACE))
        try:
            return sum([seen[p] for p in pieces])
        except KeyError:
            pass
        for piece in pieces:
            count = seen.get(piece)
            if count is None:
                count = count_piece(piece, self._ranks)
                if len(piece) <= 64:
                    if len(seen) >= self._limit:
                        seen.clear()
                    seen[piece] = count
            total += count
        return total


#: A worker process runs many tasks: it keeps one counter per vocabulary.
_counters: dict[str, PieceCounter] = {}


def count_tokens(
    docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The vocabulary (a fixed file) is read once on the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(model_path))

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model_path not in _counters:
            _counters[model_path] = PieceCounter(ranks.value)
        counter = _counters[model_path]
        for batch in batches:
            yield pa.array(np.fromiter((counter(t.as_py()) for t in batch), np.int64, len(batch)))

    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.arrow_udf(counts, "long", functionType=F.ArrowUDFType.SCALAR_ITER)(text).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
