"""Mentions of a catalog's codes in running text: many patterns in one pass over each text.

Codes and texts are compared without blanks and dashes and without regard to the case of A-Z, by an automaton over all
codes at once (a trie with failure links), so the time for a text doesn't grow with the catalog. A match stands if it
is not inside a word and its separators agree: where the code has a blank there is at least one blank or dash for each,
where it has dashes there may be some, elsewhere there is none. Of the matches that start at one place the longest code
wins, then the first by name; from left to right, matches don't overlap.

The codes travel to the workers as one broadcast list while they stay under BLOCK_BYTES; a larger catalog is dealt by
its first characters to blocks of about that size, each of which passes over the texts, and the matches of all blocks
meet again by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
BLOCK_CHARS = 1 << 20  # of texts that are read as one
END = "\0"  # between them; no match goes over it
SEPARATORS = " \t\n\x0b\f\r-"
MATCH = "array<struct<start:int,end:int,size:int,code:string>>"
_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("code", pa.string())]
_SEPARATE = np.array([ord(c) for c in SEPARATORS], np.uint32)

Found = tuple[int, int, int, str]  # start, end, minus the length of the code, code


def compacted(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text without separators in lower case, the place of each character that is left, and all characters."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.flatnonzero(~np.isin(chars, _SEPARATE))
    left = chars[kept]
    left = np.where((left >= 65) & (left <= 90), left + 32, left).astype("<u4")
    return left.tobytes().decode("utf-32-le", "surrogatepass"), kept, chars


class Codes:
    """All codes of a block and the automaton over their compact forms."""

    def __init__(self, codes: list[str]) -> None:
        import ahocorasick

        forms: dict[str, list[tuple[str, dict[int, int]]]] = {}
        for code in sorted(set(codes)):
            core, kept, chars = compacted(code.strip(SEPARATORS))
            if core:
                gaps = {}  # after which character of the core how many separators the code demands
                for i in np.flatnonzero(np.diff(kept) > 1).tolist():
                    between = chars[kept[i] + 1 : kept[i + 1]]
                    gaps[i] = int(np.count_nonzero(between != ord("-")))
                forms.setdefault(core, []).append((code, gaps))
        self._automaton = ahocorasick.Automaton()
        for core, found in forms.items():
            self._automaton.add_word(core, (len(core), found))
        if forms:
            self._automaton.make_automaton()
        self._empty = not forms

    def matches(self, texts: list[str | None]) -> list[list[Found]]:
        """All matches of each text that stand, also those that overlap; the texts are read as one, BLOCK_CHARS at a time."""
        out: list[list[Found]] = [[] for _ in texts]
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        block = (np.cumsum(lengths) - lengths) // BLOCK_CHARS if len(texts) else lengths
        for lo in np.flatnonzero(np.diff(block, prepend=-1)).tolist() if not self._empty else []:
            hi = int(np.searchsorted(block, block[lo], "right"))
            self._read([t or "" for t in texts[lo:hi]], lengths[lo:hi], out[lo:hi])
        return out

    def _read(self, texts: list[str], lengths: np.ndarray, out: list[list[Found]]) -> None:
        core, kept, chars = compacted(END.join(texts))
        hits = [(last, *found) for last, found in self._automaton.iter(core)]
        if not hits:
            return
        last, n = (np.array([h[k] for h in hits]) for k in (0, 1))
        first = last - n + 1
        start, end = kept[first], kept[last] + 1
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        owner = np.searchsorted(begins, start, "right") - 1
        edge = np.concatenate([chars, [0]])  # what is before the first is what is behind the last
        stands = ~_in_word(edge[start - 1]) & ~_in_word(edge[end]) & (owner == np.searchsorted(begins, end - 1, "right") - 1)
        gaps = np.diff(kept) - 1
        before = np.concatenate([[0], np.cumsum(gaps)])
        plain = before[last] == before[first]
        for i in np.flatnonzero(stands).tolist():
            there = gaps[first[i] : last[i]] if not plain[i] else ()
            wide = {int(k): int(there[k]) for k in np.flatnonzero(there)} if not plain[i] else {}
            k = int(owner[i])
            for code, demands in hits[i][2]:
                if wide.keys() <= demands.keys() and all(wide.get(g, 0) >= least for g, least in demands.items()):
                    out[k].append((int(start[i] - begins[k]), int(end[i] - begins[k]), -len(code), code))


def _in_word(chars: np.ndarray) -> np.ndarray:
    return ((chars >= 48) & (chars <= 57)) | ((chars >= 65) & (chars <= 90)) | ((chars >= 97) & (chars <= 122))


def chosen(found: list[Found]) -> list[Found]:
    """From left to right, of the matches of one place the longest code, without overlap."""
    out, end = [], 0
    for match in sorted(found, key=lambda m: (m[0], m[2], m[3])):
        if match[0] >= end:
            out.append(match)
            end = match[1]
    return out


def _structs(rows: list[list[Found]]) -> pa.Array:
    flat = [m for row in rows for m in row]
    columns = [pa.array([m[k] for m in flat], kind) for k, (_, kind) in enumerate(_FIELDS)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, names=[f for f, _ in _FIELDS]))


#: A worker keeps the automata of the blocks that it met last, by the broadcast's number.
_automata: dict[int, Codes] = {}


def _matcher(shared, number: int, final: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if number not in _automata:
            if len(_automata) > 3:
                _automata.clear()
            _automata[number] = Codes(shared.value)
        codes = _automata[number]
        for batch in batches:
            found = codes.matches(batch.to_pylist())
            yield _structs([chosen(f) for f in found] if final else found)

    return run


def _choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield _structs([chosen([tuple(m.values()) for m in row or []]) for row in batch.to_pylist()])


def _udf(run: Callable, kind: str = MATCH) -> Callable:
    return F.arrow_udf(run, kind, functionType=F.ArrowUDFType.SCALAR_ITER)


def with_mentions(docs: DataFrame, key: str, codes: DataFrame, text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """docs with `found`, the matches of each row in order: arrays of (start, end, size, code), places counted from 0.

    codes has (code). key tells the rows apart; null texts, null codes and codes of separators alone match nothing.
    """
    spark = docs.sparkSession
    known = codes.select("code").where("code IS NOT NULL").distinct()
    size = known.agg(F.sum(F.octet_length("code") + 64)).first()[0] or 0
    blocks = max(1, -(-size // most))
    first = F.substring(F.lower(F.translate("code", SEPARATORS, "")), 1, 3)
    dealt = known.withColumn("block", F.pmod(F.xxhash64(first, F.when(F.lit(blocks > 64), F.col("code"))), F.lit(blocks)))
    parts = []
    for b in range(blocks):  # blocks of bounded size
        shared = spark.sparkContext.broadcast([r["code"] for r in dealt.where(F.col("block") == b).select("code").collect()])
        parts.append(_udf(_matcher(shared, id(shared), blocks == 1)))
    if blocks == 1:
        return docs.withColumn("found", parts[0](text))
    found = docs.select(key, F.explode(parts[0](text)).alias("m"))
    for part in parts[1:]:
        found = found.unionByName(docs.select(key, F.explode(part(text)).alias("m")))
    met = found.groupBy(key).agg(F.collect_list("m").alias("all")).select(key, _udf(_choose)("all").alias("found"))
    return docs.join(met, key, "left").withColumn("found", F.coalesce("found", F.array().cast(MATCH)))


def mentions(docs: DataFrame, key: str, codes: DataFrame, text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """(key, pos, start, end, raw, code) of every mention, in order."""
    rows = with_mentions(docs, key, codes, text, most).select(key, text, F.posexplode("found").alias("pos", "m"))
    return rows.select(key, "pos", "m.start", "m.end", F.substring(F.col(text), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("raw"), "m.code")


def marked(rows: DataFrame, key: str, text: str, marks: dict[str, str]) -> DataFrame:
    """(key, text) of rows with `found`: behind each mention what `marks` says of it, if anything."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            yield pa.array([_with_marks(t, f, shared.value) for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    return rows.select(key, _udf(run, "string")(text, "found").alias(text))


def _with_marks(text: str | None, found: list[dict] | None, marks: dict[str, str]) -> str | None:
    if not text or not found:
        return text
    out, at = [], 0
    for m in found:
        out += [text[at : m["end"]], marks.get(text[m["start"] : m["end"]], "")]
        at = m["end"]
    return "".join(out) + text[at:]
