"""Alignment of two tokenizers' ids over the same bytes, and how often two ids meet in the corpus.

Each tokenization gives a dictionary from cumulative byte ends to indexes. The sorted common keys of both dictionaries
cut the id lists into groups; within a group each pair of tokens whose byte ranges overlap is a link.

Texts are cut where both tokenizers always cut (before a blank that follows a letter, digit or ASCII mark), so
the alignment of a text is that of its pieces one after the other, and a worker remembers pieces. Texts are worked
on in slices of about SLICE characters. A slice is a row of a written table: the pieces of each text as indexes, what each
piece consists of once, and how often each pair of ids is linked in the slice. Counts of pairs over the corpus are an
aggregate over slices; each slice gets back the counts of its own pairs, so nothing that grows with the corpus is
broadcast or held by one task, and no text is encoded twice.

Tokenizer A (byte level) encodes a blank and the text; B (pieces, which adds the blank itself) the text. Special
strings inside texts are plain text.

Result: one row per document with doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the highest of
their B id), count_sum (pair counts over links) and groups, as `a1,a2|b1;a3|b2,b3`. Texts that are null or empty, or
that either tokenizer doesn't give back byte by byte (as with U+2581), have no tokens: zeros and empty groups. Repeated
rows count each. Very long texts are cut into pieces some at a time and make a slice of their own. An empty table
gives an empty result; only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._session import written

SLICE = 6 << 20
#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 20
#: Pieces of each of the two generations that a worker remembers.
REMEMBERED = 100_000
ROW = 50  # pieces that are encoded as one text
_CUT = re.compile(r"(?<=[\w!-~])(?= .)", re.S)
_PLAIN = re.compile(r"(?s).*[\w!-~]")
_CODEC = "zstd"
SLICES = "slice long, doc_ids array<long>, sizes binary, pieces binary, numbers binary, groups binary, n_links binary, links binary, pairs binary, times binary"


def _pack(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec=_CODEC, asbytes=True)


def stretches(text: str) -> Iterator[list[str]]:
    """The pieces of a blank and the text, some at a time."""
    text, start = f" {text}", 0
    while start < len(text):
        found = _CUT.search(text, start + STRETCH) if len(text) > start + STRETCH else None
        end = found.start() if found else len(text)
        yield _CUT.split(text[start:end])
        start = end


class Aligner:
    """Aligns pieces. A piece has n_a, n_b and n_groups, its groups as text, and the id pairs of its links."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self._a.encode_special_tokens = True
        octets = _byte_level()
        self._a_bytes = {i: bytes([octets[c] for c in t]) if all(c in octets for c in t) else t.encode() for t, i in self._a.get_vocab().items()}
        piece = self._b.id_to_piece
        self._b_bytes = [bytes([int(piece(i)[1:-1], 16)]) if self._b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self._b.get_piece_size())]
        self._limit, self._young, self._old = remembered, {}, {}

    def align(self, pieces: list[str]) -> list[tuple[str, bytes] | None]:
        """(groups, packed n_a, n_b, n_groups and link pairs) of each piece; None if its bytes don't come back."""
        young, old, out, missing = self._young, self._old, [], []
        for k, piece in enumerate(pieces):
            found = young.get(piece, 0)
            if found == 0:
                found = old.get(piece, 0)
                if found == 0:
                    missing.append(k)
                elif len(young) < self._limit:
                    young[piece] = found
            out.append(found)
        plain = [k for k in missing if _PLAIN.fullmatch(pieces[k])]
        rows = [plain[i : i + ROW] for i in range(0, len(plain), ROW)]
        taken = set(plain)
        rows += [[k] for k in missing if k not in taken]
        for row, found in zip(rows, self._rows([[pieces[k] for k in row] for row in rows]), strict=True):
            for k, entry in zip(row, found, strict=True):
                out[k] = entry
                if len(pieces[k]) <= 64 and len(young) < self._limit:
                    young[pieces[k]] = entry
        if len(young) >= self._limit:
            self._old, self._young = young, {}
        return out

    def _rows(self, rows: list[list[str]]) -> Iterator[list]:
        for start in range(0, len(rows), 200):
            some = rows[start : start + 200]
            a = self._a.encode_batch_fast(["".join(row) for row in some], add_special_tokens=False)
            b = self._b.encode(["".join(row)[1:] for row in some], num_threads=1)
            for row, coded, b_ids in zip(some, a, b, strict=True):
                yield self._row(row, coded.ids, b_ids)

    def _row(self, row: list[str], a_ids: list[int], b_ids: list[int]) -> list:
        a, b = [self._a_bytes[i] for i in a_ids], [self._b_bytes[i] for i in b_ids]
        text = [piece.encode() for piece in row]
        whole = b"".join(text)
        if b"".join(a) != whole or b"".join(b) != whole:
            return [None] if len(row) == 1 else [found for piece in row for found in next(self._rows([[piece]]))]
        a_ends, b_ends = _ends(a), _ends(b)
        a_at, b_at = {e: k for k, e in enumerate(a_ends, 1)}, {e: k for k, e in enumerate(b_ends, 1)}
        common = sorted(a_at.keys() & b_at.keys())
        out, end, i, j, first_i, first_j, groups, links, due = [], 0, 0, 0, 0, 0, [], [], 0
        for cut in common:
            next_i, next_j = a_at[cut], b_at[cut]
            groups.append(f"{','.join(map(str, a_ids[i:next_i]))}|{','.join(map(str, b_ids[j:next_j]))}")
            while i < next_i and j < next_j:  # the links of this slice
                links.append(a_ids[i] << 32 | b_ids[j])
                a_end, b_end = a_ends[i], b_ends[j]
                i += a_end <= b_end
                j += b_end <= a_end
            if cut == end + len(text[due]):
                out.append((";".join(groups), np.array([i - first_i, j - first_j, len(groups), *links], "<i8").tobytes()))
                end, first_i, first_j, groups, links, due = cut, i, j, [], [], due + 1
        if due < len(row):
            raise ValueError("a tokenizer joins what lies on both sides of a cut")
        return out


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _ends(tokens: list[bytes]) -> list[int]:
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


#: A worker process keeps the aligner that it used last.
_aligners: dict[tuple[str, str], Aligner] = {}


def _slice(aligner: Aligner, ids: list[int | None], texts: list[str | None]) -> dict:
    known: dict[str, int] = {}
    rows = []
    for text in texts:
        found = [np.fromiter((known.setdefault(p, len(known)) for p in some), np.uint32, len(some)) for some in stretches(text)] if text else []
        rows.append(np.concatenate(found) if found else np.zeros(0, np.uint32))
    entries = aligner.align(list(known))
    bad = np.array([e is None for e in entries], bool)
    if bad.any():
        rows = [row[:0] if bad[row].any() else row for row in rows]
    blank = ("", bytes(24))
    entries = [blank if e is None else e for e in entries]
    numbers = np.frombuffer(b"".join([e[1][:24] for e in entries]), "<i8").reshape(-1, 3)
    links = np.frombuffer(b"".join([e[1][24:] for e in entries]), "<i8")
    n_links = np.array([len(e[1]) // 8 - 3 for e in entries], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    often = np.bincount(flat, minlength=len(entries))
    pairs, which = np.unique(links, return_inverse=True)
    times = np.bincount(which, weights=np.repeat(often, n_links), minlength=len(pairs)).astype("<i8")
    met = times > 0
    place = np.cumsum(met) - 1
    return {
        "slice": uuid.uuid4().int >> 65, "doc_ids": ids, "sizes": _pack(np.array([len(r) for r in rows], "<i8")), "pieces": _pack(flat.astype("<u4")),
        "numbers": _pack(numbers), "groups": _pack("\n".join([e[0] for e in entries]).encode()), "n_links": _pack(n_links.astype("<i8")),
        "links": _pack(np.where(met, place, -1)[which].astype("<i4")), "pairs": pairs[met].astype("<i8").tobytes(), "times": times[met].tobytes(),
    }


def _slice_rows(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    schema = pa.schema([("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("sizes", "pieces", "numbers", "groups", "n_links", "links", "pairs", "times")]])
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += 64 + len(texts[-1] or "")
            if size >= SLICE:
                yield pa.RecordBatch.from_pylist([_slice(aligner, ids, texts)], schema)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([_slice(aligner, ids, texts)], schema)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("slice", "pairs", "times")), strict=True):
            pair = np.frombuffer(pairs, "<i8")
            for start in range(0, len(pair), 50_000):
                own = slice(start, start + 50_000)
                n = len(pair[own])
                arrays = [np.full(n, key), np.arange(start, start + n, dtype=np.int32), pair[own], np.frombuffer(times, "<i8")[own]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["slice", "place", "pair", "n"])


def _documents(slices: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one slice, from the slice and the corpus counts of its pairs."""
    row = slices.slice(0, 1).to_pylist()[0]
    place = pairs.column("place").to_numpy()
    count, best = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)  # the last is for links of no document
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    read = lambda c, kind: np.frombuffer(_unpack(row[c]), kind)
    links, n_links, numbers, pieces, sizes = read("links", "<i4"), read("n_links", "<i8"), read("numbers", "<i8").reshape(-1, 3), read("pieces", "<u4"), read("sizes", "<i8")

    def over(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[ends] - sums[ends - sizes]

    of_piece = [numbers[:, 0], numbers[:, 1], numbers[:, 2], n_links, over(best[links], n_links), over(count[links], n_links)]
    columns = [pa.array(over(v[pieces], sizes), pa.int64()) for v in of_piece]
    texts = _unpack(row["groups"]).decode().split("\n")
    ends = np.cumsum(sizes)
    groups = [";".join([texts[p] for p in pieces[a:b].tolist()]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), *columns, pa.array(groups, pa.string())], names=names)


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners.clear()
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        yield from _slice_rows(_aligners[a_path, b_path], batches)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slices = written(rows.mapInArrow(sliced, SLICES), "slices")
    pairs = slices.select("slice", "pairs", "times").mapInArrow(_pair_rows, "slice long, place int, pair long, n long")
    pairs = written(pairs, "pairs")
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(b_id).agg(F.max("count").alias("most"))
    ranked = counts.withColumn("b", b_id).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    known = pairs.select("slice", "place", "pair").join(ranked, "pair").select("slice", "place", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return slices.drop("pairs", "times").groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(_documents, schema)
