"""Token ids as binary shards with a minimal perfect hash index.

A shard holds the raw little-endian ids of documents in ascending doc_id order, one after the other, and an
index over its keys: a minimal perfect hash maps a key to a slot, the slot holds a fingerprint of the key, the
offset of its first document in the payload and the number of ids. So a key is found in constant time (a few
bits and one sampled rank), and a foreign key is turned away unless its fingerprint agrees by chance
(2 ** -32). Shards are rows of a Parquet table (one shard a row and row group, about SHARD_BYTES of payload), so
Spark's commit protocol covers lost tasks and any store that Spark can write serves. A lookup reads the index
columns first and the payload only of shards that hold a wanted key.

The hash is a cascade of bit arrays: at each level the keys that land alone on a bit are placed there, the
rest go on; a key's slot is the rank of its bit.

Documents are ordered by doc_id (null first), then by a hash of the text. Rows with equal doc_id follow one
another and share a key; a shard may end between them, so no key's rows have to fit in one shard. Null texts
are empty and consist of the end id alone. Very long texts are encoded whole and make a shard of their own.
An empty table gives no shards and no rows; only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import _words as W
from leafmill.llm._session import attach, shared_dir, written

END_ID = 1
SHARD_BYTES = 4 << 20
PARTITION_ROWS = 20_000
#: Parts of texts whose ids a worker process remembers; when they are too many, the half used most often stays.
REMEMBERED = 240_000
ROW = 50  # runs of letters that are encoded as one text
LEVELS = 48
RANK_EVERY = 64  # bytes of bits between two stored ranks
SCHEMA = (
    "null_key boolean, first_key long, first_tie long, part int, last_key long, n_docs long, n_tokens long, width int, keys binary, lengths binary, "
    "levels binary, bits binary, ranks binary, fingerprints binary, offsets binary, counts binary, ids binary"
)
ORDER = ["null_key", "first_key", "first_tie", "part"]
INDEX = ["levels", "bits", "ranks", "fingerprints", "offsets", "counts"]
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)

#: Bytes of a run of Latin letters up to U+027F; other scripts don't take part.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
#: Two-byte characters among them after which no run may be cut: the signs for times and divided, and U+0130,
#: whose lower case ends in a combining mark.
_UNFIT = [0xC397, 0xC3B7, 0xC4B0]


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return W.mix(keys.view(np.uint64) ^ W.mix(np.array([seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 10_000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays and a rank for every RANK_EVERY bytes of them."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> None:
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, parts, left = [], [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = int(len(left) * room) + 8
            at = (_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        bits = np.packbits(np.concatenate(parts) if parts else np.zeros(0, bool), bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % RANK_EVERY, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, RANK_EVERY).sum(1))]).astype("<i4")
        return cls(np.array(levels, "<i8"), bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not built in, any slot for the others."""
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.levels.tolist()):
            at = start + (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
            start += size
            byte = self.bits[at >> 3]
            hit = (byte >> (at & 7).astype(np.uint8) & 1).astype(bool)
            out[open_[hit]] = self._rank(at[hit])
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before `at`: the stored rank, whole bytes after it, and the bits of the last byte."""
        byte = at >> 3
        block = byte // RANK_EVERY
        within = np.arange(RANK_EVERY)
        held = _ONES[self.bits[(block * RANK_EVERY)[:, None] + within]]
        last = self.bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return self.ranks[block] + (held * (within < (byte % RANK_EVERY)[:, None])).sum(1) + _ONES[last]


class Encoder:
    """Ids of slices of whole texts; the parts that they consist of are encoded once and remembered.

    The vocabulary drops white space, never joins across it, and keeps letters apart from other characters. So a
    text is cut at blanks, and a word after the Latin letters that it starts with if an ASCII mark or digit
    follows; the ids of a text are those of its parts. Parts of a slice are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self._tokenizer.get_vocab_size() <= 65_536 else 4
        self._closes = np.zeros(1 + max(self._tokenizer.get_vocab().values()), bool)  # ids that end a word
        self._closes[[i for t, i in self._tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._limit = remembered
        self._slot: dict[bytes, int] = {}
        self._ids = np.array([END_ID], f"<u{self.width}")  # slot 0 is the end of a text
        self._sizes = np.ones(1, np.int64)
        self._used = np.zeros(1, np.int64)  # slices that had the part

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and the number of ids of each."""
        w = W.Words(texts)
        starts, ends, text = self._parts(w)
        _, first, which = np.unique(w.spans(starts, ends), return_index=True, return_inverse=True)
        data = w.data.tobytes()
        parts = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slot = self._slots(parts)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self._slot) + len(new) > self._limit:
                self._forget()
                slot = self._slots(parts)
                new = np.flatnonzero(slot < 0)
            self._learn([parts[i] for i in new.tolist()])
            slot[new] = self._slots([parts[i] for i in new.tolist()])
        self._used[slot] += 1
        per_text = np.bincount(text, minlength=len(texts))
        slots = np.insert(slot[which], np.cumsum(per_text), 0)
        begin, n = (np.cumsum(self._sizes) - self._sizes)[slots], self._sizes[slots]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        per_text = np.bincount(np.repeat(np.arange(len(texts)), per_text + 1), weights=n, minlength=len(texts))
        return self._ids[at], per_text.astype(np.int64)

    def _slots(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._slot.get, parts, itertools.repeat(-1)), np.int64, len(parts))

    def _forget(self) -> None:
        """Keep the half of the table that was used most often."""
        kept = np.argsort(-self._used[1:], kind="stable")[: self._limit // 2] + 1
        kept = np.concatenate([[0], np.sort(kept)])
        place = np.zeros(len(self._sizes), np.int64)
        place[kept] = np.arange(len(kept))
        where = place.tolist()
        self._slot = {p: where[slot] for p, slot in self._slot.items() if where[slot]}
        stays = np.zeros(len(self._sizes), bool)
        stays[kept] = True
        self._ids = self._ids[np.repeat(stays, self._sizes)]
        self._sizes, self._used = self._sizes[kept], self._used[kept] // 2

    @staticmethod
    def _parts(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each part, in order."""
        others = np.append(np.flatnonzero(~_LETTER[w.data]), len(w.data))
        stop = others[np.searchsorted(others, w.starts)] if len(w.starts) else w.starts
        cut = (stop > w.starts) & (stop < w.ends)
        at = np.flatnonzero(cut)
        stop_at = stop[at]
        before = w.data[stop_at - 1].astype(np.int64) + (w.data[np.maximum(stop_at - 2, 0)].astype(np.int64) << 8)
        cut[at] = (w.data[stop_at] < 0x80) & ~np.isin(before, _UNFIT)
        at = np.flatnonzero(cut)
        starts = np.insert(w.starts, at + 1, stop[at])
        ends = np.insert(w.ends, at, stop[at])
        return starts, ends, np.insert(w.text, at, w.text[at])

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode() for p in parts]
        rows = [[i for i in range(start, min(start + ROW, len(parts))) if texts[i].isalpha()] for start in range(0, len(parts), ROW)]
        alone = [i for i, t in enumerate(texts) if not t.isalpha()]
        known, ids_of, sizes_of = [], [], []
        for row, ids in zip(rows, self._encoded([" ".join([texts[i] for i in row]) for row in rows]), strict=True):
            ends = np.flatnonzero(self._closes[ids]) + 1
            if len(ends) == len(row):  # each run of letters is one word to the vocabulary
                known += [parts[i] for i in row]
                ids_of.append(ids)
                sizes_of.append(np.diff(ends, prepend=0))
            else:
                alone += row
        for i, ids in zip(alone, self._encoded([texts[i] for i in alone]), strict=True):
            known.append(parts[i])
            ids_of.append(ids)
            sizes_of.append(np.array([len(ids)]))
        first = len(self._sizes)
        self._slot.update(zip(known, range(first, first + len(known)), strict=True))
        self._ids, self._sizes = np.concatenate([self._ids, *ids_of]), np.concatenate([self._sizes, *sizes_of])
        self._used = np.concatenate([self._used, np.zeros(len(known), np.int64)])

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for start in range(0, len(texts), 2_000):
            for coded in self._tokenizer.encode_batch_fast(texts[start : start + 2_000], add_special_tokens=False):
                yield np.array(coded.ids, f"<u{self.width}")


#: A worker process keeps the encoder that it used last.
_encoders: dict[str, Encoder] = {}


def _shard(keys: list[int | None], ids: bytes, lengths: np.ndarray, width: int, tie: int = 0, part: int = 0) -> dict:
    known = np.array([0 if k is None else k for k in keys], "<i8")
    named = known[np.array([k is not None for k in keys], bool)]
    n_null = len(known) - len(named)  # null keys come first
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    distinct, first, several = np.unique(named, return_index=True, return_counts=True)
    first = first + n_null
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    marks, places, counts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
    marks[slot], places[slot], counts[slot] = fingerprint(distinct), offsets[first], offsets[first + several] - offsets[first]
    return {
        "null_key": keys[0] is None, "first_key": int(named[0]) if len(named) else None, "first_tie": tie, "part": part,
        "last_key": int(named[-1]) if len(named) else None, "n_docs": len(keys), "n_tokens": int(lengths.sum()),
        "width": width, "keys": struct.pack("<q", n_null) + named.tobytes(), "lengths": lengths.astype("<i8").tobytes(),
        "levels": hashed.levels.tobytes(), "bits": hashed.bits.tobytes(), "ranks": hashed.ranks.tobytes(),
        "fingerprints": marks.tobytes(), "offsets": places.tobytes(), "counts": counts.tobytes(), "ids": ids,
    }


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])


def write_shards(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append END_ID and write shards under path; returns the table read back."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    n = max(1, -(-rows.select("key").count() // PARTITION_ROWS))
    ordered = rows.repartitionByRange(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key", "tie")
    ordered = ordered.sortWithinPartitions("key", "tie")
    schema = _arrow_schema()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders.clear()
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, keys, ids, lengths, tie, done = _encoders[tokenizer], [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(keys, b"".join(ids), np.concatenate(lengths), encoder.width, tie, done)], schema)

        for batch in batches:
            for start, part in W.pieces(batch.column("text"), min(W.PIECE_BYTES, shard_bytes)):
                if not keys:
                    tie = batch.column("tie")[start].as_py()
                found, sizes = encoder.encode(part)
                keys += batch.column("key").slice(start, len(part)).to_pylist()
                ids.append(found.tobytes())
                lengths.append(sizes)
                if sum(map(len, ids)) >= shard_bytes:
                    yield shard()
                    keys, ids, lengths, done = [], [], [], done + 1
        if keys:
            yield shard()

    ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").option("parquet.block.size", shard_bytes).parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


class Index:
    """Keyed access to the offsets of one shard: (offset, number of ids) of each key."""

    def __init__(self, row: dict) -> None:
        self._hash = PerfectHash(np.frombuffer(row["levels"], "<i8"), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["ranks"], "<i4"))
        self._marks = np.frombuffer(row["fingerprints"], "<u4")
        self._places = np.frombuffer(row["offsets"], "<i8")
        self._counts = np.frombuffer(row["counts"], "<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset of the first id of each key, -1 where the shard does not have it, and how many there are."""
        slot = self._hash.slots(keys)
        held = slot >= 0
        held[held] = self._marks[slot[held]] == fingerprint(keys[held])
        out, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        out[held], counts[held] = self._places[slot[held]], self._counts[slot[held]]
        return out, counts


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            ids, lengths = np.frombuffer(row["ids"], f"<u{row['width']}"), np.frombuffer(row["lengths"], "<i8")
            n_null = struct.unpack("<q", row["keys"][:8])[0]
            keys = np.frombuffer(row["keys"], "<i8", offset=8)
            begin = np.zeros(len(lengths), np.int64)
            np.cumsum(lengths[:-1], out=begin[1:])
            named, _ = Index(row).find(keys)
            if (named < 0).any():
                raise ValueError("a key of the manifest is not in the index")
            again = np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.zeros(0, bool)
            begin[n_null:] = np.where(again, begin[n_null:], named)
            sums = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(begin.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.nulls(n_null, pa.int64()), pa.array(keys)]), pa.array(begin + row["start"]), pa.array(lengths), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def with_starts(shards: DataFrame) -> DataFrame:
    """The shards with `start`, the number of ids in all shards before.

    Sums are run within ranges of shards and over one row a range, so no task orders all shards.
    """
    order = [F.desc("null_key"), "first_key", "first_tie", "part"]
    sizes = shards.select(*ORDER, "n_tokens").repartitionByRange(*order)
    sizes = written(sizes.withColumn("block", F.spark_partition_id()), "sizes")
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    key = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ORDER]).alias("shard")
    starts = within.join(blocks, "block").select(key, (F.col("ahead") + F.col("within")).alias("start"))
    return attach(shards.select("*", key), written(starts, "starts"), ["shard"], "inner").drop("shard")


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens and the checksum of its ids."""
    return with_starts(shards).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, ids) for the rows of keys (column `key`) that the shards hold, found through the index.

    A key meets the shards whose key range holds it in their index columns alone, dealt by key range. Then the
    payload of the shards found is read. A key whose rows several shards share gives one row for each of them.
    """
    index = shards.where("first_key IS NOT NULL").select(*ORDER, "last_key", *INDEX)
    ranges = index.select("first_key").repartitionByRange("first_key").groupBy(F.spark_partition_id()).agg(F.min("first_key").alias("low"))
    bounds = sorted(r["low"] for r in ranges.collect())  # one a shuffle partition
    block = lambda c: F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<long>"), lambda low: low <= F.col(c)))
    index = index.withColumn("block", F.explode(F.sequence(block("first_key"), block("last_key"))))
    asked = keys.where("key IS NOT NULL").select("key").distinct().withColumn("block", block("key"))
    routed = index.join(asked, "block").where("key BETWEEN first_key AND last_key")
    wanted = routed.groupBy(*ORDER).agg(F.collect_set("key").alias("wanted"), *[F.first(c).alias(c) for c in INDEX])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = np.array(row["wanted"], np.int64)
                at, n = Index(row).find(found)
                held = np.flatnonzero(at >= 0)
                head = {c: [row[c]] * len(held) for c in ORDER}
                yield pa.RecordBatch.from_pydict(head | {"key": found[held], "at": at[held], "n": n[held]}, schema)

    out = "null_key boolean, first_key long, first_tie long, part int, key long, at long, n long"
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in out.split(", "))])
    found = written(wanted.mapInArrow(places, out), "found")
    payload = shards.select(*ORDER, "width", "ids").join(found, ORDER)  # null keys meet no one
    cut = payload.select("key", "width", F.expr("substring(ids, CAST(at * width + 1 AS INT), CAST(n * width AS INT))").alias("raw"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(r, f"<u{w}").astype(np.int32) for r, w in zip(batch.column("raw").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return cut.mapInArrow(unpack, "key long, ids array<int>")


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the shards (by default in the shared folder) and read the documents back from them."""
    path = path or f"{shared_dir(docs.sparkSession).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    return read_documents(write_shards(docs, tokenizer, path))
