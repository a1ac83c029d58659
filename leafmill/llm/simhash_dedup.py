"""SimHash near-duplicate components by an inverted index over positional bytes with count filtering.

A fingerprint has 64 bits; a bit is one if more than half of the hashes of the text's word shingles have it. Two
fingerprints that differ in at most BITS bits differ in at most BITS of their eight bytes, so they share at least
8 - BITS bytes at equal positions. The index posts fingerprints under bytes at positions. Postings of single bytes
would each hold a 256th of the corpus, so a posting takes the bytes of four positions at once: of four pairs of
positions, two are always spared, and the six sets of two pairs miss no link. Within a posting the shared
positional bytes of each pair are tallied; pairs under the guaranteed minimum go, the others are verified by their
differing bits.

Equal fingerprints are folded first, so copies cost nothing. A posting of more than LARGE different fingerprints is
posted anew under six bytes (its four and any two of the others, which a link must share as well): such a posting
holds at most 65,536 different fingerprints, and where it is larger than LARGE the neighbours of each are looked up
instead of meeting all others. So no list grows without bound, no pair is lost, and each posting gives only the links
that join its fingerprints to components, fewer than it has members.

Result: one row per row of docs with its fingerprint (16 hex digits) and component_id, the smallest doc_id that can be
reached over links, itself included. Texts that are null or have no word have fingerprint zero and link like any other.
Texts with fewer words than a shingle are one shingle. Rows with equal doc_id are rows of their own; null doc_ids are
never the smallest, and a component without any other has a null component_id. Very long texts are hashed whole, in
slices. An empty table gives an empty result; only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._session import attach, written
from leafmill.llm.minhash_dedup import components

SHINGLE = 3
SEED = 42
BITS = 2
LARGE = 2048
#: Bytes of text whose words are held at once.
SLICE = 1 << 20
#: Positions of each posting: two of the four pairs of bytes.
SETS = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in itertools.combinations(range(4), 2)]
_WEIGHT = np.arange(256)[:, None] >> np.arange(8)[None, :] & 1
_LOW = np.uint64(0x0101010101010101)


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time."""
    start = 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[start:end].split()
        start = end


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words split at blanks, shingles joined by one space."""
    from xxhash import xxh64_intdigest

    counts, n, kept = np.zeros(64, np.int64), 0, []
    for words in itertools.chain(_slices(text.lower()), [None]):
        if words is None:  # a text of fewer words than a shingle
            if n or not kept:
                break
            words, kept = [b" ".join(kept)], []
            hashes = [xxh64_intdigest(words[0], SEED)]
        else:
            words = kept + words
            kept = words[1 - SHINGLE :]
            joined = b" ".join(words)
            ends = list(itertools.accumulate([len(w) + 1 for w in words]))
            hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)]
        if hashes:
            n += len(hashes)
            octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
            counts += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _WEIGHT).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        blobs = batch.cast(pa.large_binary())
        yield pa.array(np.array([fingerprint(t.as_py() or b"") for t in blobs], np.uint64).view(np.int64))


def _key(positions: tuple[int, ...]) -> Column:
    mask = int.from_bytes(bytes(0xFF * (p in positions) for p in range(8)), "little", signed=True)
    return F.xxhash64(F.lit(mask), F.col("fp").bitwiseAND(F.lit(mask))).alias("key")


def _postings(prints: DataFrame) -> tuple[DataFrame, int]:
    """(key, set, fp): each fingerprint under the bytes of each set of four positions."""
    keys = [F.struct(F.lit(s).alias("set"), _key(positions)) for s, positions in enumerate(SETS)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.col("k.key").alias("key"), F.col("k.set").alias("set"), "fp")


def _finer(postings: DataFrame) -> DataFrame:
    """Postings of large lists by six bytes: their four and each two of the others."""
    keys = []
    for positions in SETS:
        rest = [p for p in range(8) if p not in positions]
        keys.append(F.array(*[_key((*positions, *two)) for two in itertools.combinations(rest, 2)]))
    return postings.select("fp", F.explode(F.element_at(F.array(*keys), F.col("set") + 1)).alias("key"))


def _differing_bytes(x: np.ndarray) -> np.ndarray:
    for shift in (4, 2, 1):
        x = x | (x >> np.uint64(shift))
    return (x & _LOW) * _LOW >> np.uint64(56)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each end to the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tallied(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of lists: flat holds all lists, ends the end of the list of each member."""
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    held, at, step = 0, np.arange(len(flat)), 0
    while True:
        step += 1
        at = at[at + step < ends[at]]
        if not len(at):
            break
        a, b = flat[at], flat[at + step]
        differ = a ^ b
        enough = np.flatnonzero(8 - _differing_bytes(differ) >= 8 - BITS)  # the tally of shared positional bytes
        enough = enough[np.bitwise_count(differ[enough]) <= BITS]
        found_a.append(a[enough])
        found_b.append(b[enough])
        held += len(enough)
        if held > 1_000_000:  # what the links found so far join is enough
            a, b = _spanning(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
    return np.concatenate(found_a), np.concatenate(found_b)


def _looked_up(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one long list that differs in few bits: each fingerprint with up to BITS of them turned."""
    prints = np.sort(prints)
    free = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for n in range(1, BITS + 1):
        for turned in itertools.combinations(bits, n):
            other = prints ^ np.bitwise_or.reduce(np.array(turned, np.uint64))
            at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
            hit = (prints[at] == other) & (other > prints)
            a, b = _spanning(np.concatenate([a, prints[hit]]), np.concatenate([b, other[hit]]))
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("prints")
        sizes = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten()).view(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        long = np.flatnonzero(sizes > LARGE)
        a, b = _tallied(flat, np.where(np.repeat(sizes, sizes) > LARGE, 0, ends))
        for i in long.tolist():
            stop = int(sizes[: i + 1].sum())
            more = _looked_up(flat[stop - int(sizes[i]) : stop])
            a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
        a, b = _spanning(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """For different fingerprints (fp): links (a, b) that join all that differ in at most BITS bits to components."""
    postings = _postings(prints)
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"))
    shared = written(sizes.where("n > 1"), "postings")
    met = postings.join(shared.hint("merge"), "key")
    lists = met.where(F.col("n") <= LARGE).select("key", "fp")
    large = shared.where(F.col("n") > LARGE)
    if not large.isEmpty():
        lists = lists.unionByName(_finer(met.where(F.col("n") > LARGE)).select("key", "fp"))
    lists = lists.groupBy("key").agg(F.collect_list("fp").alias("prints")).where(F.size("prints") > 1)
    return written(lists.select("prints").mapInArrow(_links, "a long, b long"), "links")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    fp = F.arrow_udf(_fingerprints, "long", functionType=F.ArrowUDFType.SCALAR_ITER)(text)
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fp.alias("fp")), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")), "prints")
    joined = components(links(prints.select("fp")))
    labelled = prints.join(joined.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("lead").alias("component_id"), F.sum("n").alias("size"))
    least = written(least.where("size > 1"), "components")
    several = written(labelled.join(least, "label").select("fp", "component_id", F.lit(True).alias("joined")), "joined")
    found = attach(rows, several, ["fp"], "left")
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
