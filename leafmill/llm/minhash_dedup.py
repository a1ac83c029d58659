"""Near-duplicate groups by order MinHash with banded alignment.

The k-mers are windows of SHINGLE words, each labelled with its occurrence number in the text. A sketch holds
the PICKS k-mers of lowest hash in the order in which the text has them, so it is sensitive to edits and to
order. Texts that share a sketch are candidates. Two texts are near duplicates if their best order-keeping
alignment of words, c long, has c / (a + b - c) >= SIMILARITY: at most about one word in nine changed. Only words
in the band that such an alignment can't leave are matched. Sketches say little on texts of few windows, so pairs
with a text of at most SHORT words are found exactly: texts of a size that such pairs can have also share buckets
by size and single words, the rarest ones, as many as a pair that is alike cannot all differ in.

Exact copies are folded into one representative first. Candidates are compared in stars: in each bucket of
texts with an equal sketch one centre, the text with the most company, meets the others. Every pair that is
still apart then is compared, block by block; sizes and counts of words that occur in both, upper bounds of c,
rule out most pairs before the alignment. A bucket of more than LARGE such texts, as a passage that many share
makes it, is first divided by the rarest words of its texts, by the same rule as for short texts: no pair that
can be alike is lost, and texts that have only the passage in common don't meet. In a bucket whose members form
one class nothing is left, so a group of thousands of alike copies costs a few comparisons for each member.

Result: one row per document with the class it belongs to, class_id being the smallest doc_id of the class,
class_size the number of its documents and n_links the number of its text's verified links to others.
Texts without a word are alone, also when they are equal. Rows with equal doc_id and equal text are one
document. A null doc_id sorts last. Classes are connected components: members need not all be alike. Very long
texts are sketched and aligned whole. An empty table gives an empty result; only the named columns are read,
so other columns don't clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _words as W
from leafmill.llm._session import attach, document_key, original_id, scratch, written

SHINGLE = 5
PICKS = 3
SKETCHES = 32
SIMILARITY = 0.8
BLOCK = 32  # texts
LARGE = 4096  # texts of a bucket in which all pairs may meet
BINS = 512  # of words, for an upper bound of those that two texts have in common
#: Words of a text up to which all its near duplicates are found, and of the largest text that can be one.
SHORT = 32
REACH = int(SHORT / SIMILARITY + 1e-9)
WHOLE = 2048  # words up to which a text is aligned over all its bits
FREQUENT = 64  # places in a longer text
_SEEDS = W.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(values: np.ndarray) -> np.ndarray:
    """Values mixed with their occurrence number, so all are distinct."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return values
    at = np.arange(len(values))
    label = np.zeros(len(values), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return W.mix(values + label * np.uint64(0xD6E8FEB86659FD93))


def labelled_kmers(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of one text; shorter texts are one k-mer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return labelled(W.mix(W.windows(hashes, min(SHINGLE, len(hashes)))))


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One value for each sketch of a text; equal values of the same sketch mean equal ordered picks."""
    out = np.zeros(SKETCHES, np.uint64)
    picks = min(PICKS, len(kmers))
    for block in np.array_split(np.arange(SKETCHES), 1 + len(kmers) * SKETCHES // 2_000_000):
        values = (kmers[None, :] ^ _SEEDS[block, None]) * (_SEEDS[block, None] | np.uint64(1))
        low = np.argpartition(values, picks - 1, axis=1)[:, :picks]
        chosen = kmers[np.sort(low, axis=1)]
        folded = _SEEDS[block].copy()
        for k in range(picks):
            folded = W.mix(folded + chosen[:, k])
        out[block] = folded
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """c / (a + b - c) of the best banded alignment of two lists of words; 0 if under `least`.

    The alignment is computed a word of b at a time, for all words of a at once in the bits of one integer: a
    bit goes out where the best alignment grows.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))  # matches
    if not n or not m or min(n, m) < need:
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    if np.isin(a, b).sum() < need or np.isin(b, a).sum() < need:
        return 0.0
    c = _aligned_whole(a, b, need) if n <= WHOLE else _aligned_sliding(a, b, need)
    found = c / (n + m - c)
    return found if found >= least else 0.0


def _aligned_whole(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Length of the best alignment within the band, over the bits of all of a: len(a) bits for each distinct word."""
    n, m = len(a), len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    behind = m - need
    band = (1 << (n + m - 2 * need + 1)) - 1
    full = left = (1 << n) - 1
    for j, y in enumerate(b.tolist()):
        met = places.get(y, 0)
        if met:
            met &= band << (j - behind) if j > behind else band >> (behind - j)
            met &= left
            left = ((left + met) | (left - met)) & full
    return n - left.bit_count()


def _aligned_sliding(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """The same over the bits of the band alone, which slides along: a bit that went out counts when it leaves.

    Memory grows with the words, not their square: of words that are frequent in a the bits within the band are
    kept, others are looked up in the list of their places.
    """
    n, m = len(a), len(b)
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        if x in places:
            places[x].append(i)
        else:
            places[x] = [i]
    width = n + m - 2 * need + 1
    top, full, c = 1 << (width - 1), (1 << width) - 1, 0
    left, kept = full, {}
    for base, y in enumerate(b.tolist(), need - m):  # the place in a of the lowest bit
        own = places.get(y)
        if own:
            k, last, met = 0, base, 0
            if len(own) > FREQUENT:
                met, last, k = kept.get(y, (0, base, 0))
                met >>= base - last
            elif own[0] < base:
                k = bisect.bisect_left(own, base)
            while k < len(own) and own[k] < base + width:
                if own[k] >= base:
                    met |= 1 << (own[k] - base)
                k += 1
            if len(own) > FREQUENT:
                kept[y] = met, base, k
            met &= left
            if met:
                left = ((left + met) | (left - met)) & full
        c += 1 - (left & 1)
        left = left >> 1 | top
    return c + width - left.bit_count()


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, part in W.pieces(batch.column("text")):
            w = W.Words(part)
            hashes = w.hashes()
            rows, sizes, values, packed, terms = [], [], [], [], []
            for k, (first, n) in enumerate(zip(w.first.tolist(), w.counts.tolist(), strict=True)):
                if n:
                    own = hashes[first : first + n]
                    rows.append(start + k)
                    sizes.append(n)
                    values.append((sketches(labelled_kmers(own)) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    packed.append((own >> np.uint64(32)).astype("<u4").tobytes())
                    terms.append((labelled(own) >> np.uint64(32)).astype("<u4").view("<i4") if n <= REACH else np.zeros(0, "<i4"))
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int32))
            bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SKETCHES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(bounds, flat), pa.array(packed, pa.binary()), pa.array(terms, pa.list_(pa.int32()))],
                names=["node", "n", "sketches", "words", "terms"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c) for c in ("a_words", "b_words"))
        same = [similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) > 0 for x, y in zip(a, b, strict=True)]
        kept = batch.filter(pa.array(same, pa.bool_()))
        yield kept.select(["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are alike."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("words").alias(f"{c}_words"))
    node = pairs.schema["a"].dataType.simpleString()
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_words", "b_words")
    return written(full.mapInArrow(_verify, f"a {node}, b {node}"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b), the label being the least node of the component.

    Large-star and small-star steps alternate until the edges are stars: every node has one edge, to a node
    that has none itself.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "small")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) of the classes so far, joined by new links (a, b)."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    found = written(components(ends), "components")
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    fresh = found.join(labels.select("node"), "node", "left_anti")
    return written(moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(fresh), "labels")


def _alike_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _rarest(terms: DataFrame) -> DataFrame:
    """From terms (node, n, term), all distinct words of texts: of each text the rarest ones, as (node, n, term).

    Alike texts have at least SIMILARITY * n words in common, so with all words in one order, by frequency, each
    has a common one among its first n - ceil(SIMILARITY * n) + 1. Words of one text only come first and are left out.
    """
    often = written(terms.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = attach(terms, often, ["term"], "inner").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("r"))
    first = F.col("n") - _least_size() + 1 - (F.col("n") - F.size("r"))
    return ranked.select("node", "n", F.explode(F.slice("r", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))["term"]).alias("term"))


def _least_size() -> Column:
    return F.ceil(SIMILARITY * F.col("n") - 1e-9).cast("int")


def _rare_terms(rows: DataFrame) -> DataFrame:
    """(node, n, band, value): the rarest words of short texts with each size that an alike one may have at
    least, SKETCHES being their band. The smaller of two texts gives the size of the bucket in which they meet.
    """
    terms = _rarest(rows.where(F.size("terms") > 0).select("node", "n", F.explode("terms").alias("term")))
    met = terms.select("node", "n", "term", F.explode(F.sequence(_least_size(), "n")).alias("size"))
    return written(met.select("node", "n", F.lit(SKETCHES).alias("band"), F.hash("term", "size").alias("value")), "terms")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (node, text) of different texts: verified links (a, b), and (node, label) of the linked nodes."""
    node = docs.schema["node"].dataType.simpleString()
    rows = written(docs.mapInArrow(_sketch_rows, f"node {node}, n int, sketches array<int>, words binary, terms array<int>"), "sketches")
    buckets = rows.select("node", "n", F.posexplode("sketches").alias("band", "value")).unionByName(_rare_terms(rows))
    shared = written(buckets.groupBy("band", "value").agg(F.count("*").alias("company")).where("company > 1"), "shared")
    members = written(attach(buckets, shared, ["band", "value"], "inner"), "members")
    company = written(members.groupBy("node").agg(F.sum("company").alias("company")), "company")
    members = written(attach(members.drop("company"), company, ["node"], "inner"), "ranked")
    texts = written(attach(rows.select("node", "words"), company.select("node"), ["node"], "left_semi"), "words")
    spark = docs.sparkSession
    links = spark.createDataFrame([], f"a {node}, b {node}")
    labels = spark.createDataFrame([], f"node {node}, label {node}")
    for last in (False, True):
        known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        centres = known.groupBy("band", "value").agg(
            F.max_by(F.struct("node", "n", "label"), F.struct("company", "node")).alias("c"), F.min("label").alias("least"), F.max("label").alias("most")
        )
        open_buckets = written(centres.where("least != most").select("band", "value", "c"), "centres")
        if open_buckets.isEmpty():
            break
        if last:
            new = _apart(known, rows)
        else:
            near = known.join(open_buckets.hint("merge"), ["band", "value"]).where((F.col("label") != F.col("c.label")) & _alike_in_size(F.col("n"), F.col("c.n")))
            pairs = near.select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b")).distinct()
            new = verified(pairs, texts)
        links = links.unionByName(new)
        labels = _joined(labels, new)
    return links, labels


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the members of two blocks of one bucket, or within one block."""
    for batch in batches:
        a, b = [], []
        for band, same, left, right in zip(*(batch.column(c) for c in ("band", "same", "left", "right")), strict=True):
            x, y = left.values, right.values
            for i, j in _alike(x, y, band.as_py(), same.as_py()):
                ends = sorted((x.field("node")[i].as_py(), y.field("node")[j].as_py()), key=lambda node: tuple(node.values()))
                a.append(ends[1])
                b.append(ends[0])
        kind = batch.schema.field("left").type.value_type.field("node").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])


def _alike(x: pa.StructArray, y: pa.StructArray, band: int, same: bool) -> Iterator[tuple[int, int]]:
    """Indexes of the linked pairs of two blocks that meet in this band first and are of different classes."""
    codes: dict[tuple, int] = {}
    labels = [np.array([codes.setdefault(tuple(v.values()), len(codes)) for v in block.field("label").to_pylist()]) for block in (x, y)]
    n, m = (np.asarray(block.field("n"))[:, None] for block in (x, y))
    likely = (np.minimum(n, m.T) >= SIMILARITY * np.maximum(n, m.T)) & (labels[0][:, None] != labels[1])
    i, j = np.nonzero(np.triu(likely, 1) if same else likely)
    left, right = (np.asarray(block.field("sketches").flatten()).reshape(-1, SKETCHES) for block in (x, y))
    equal = left[i] == right[j]
    first = np.where(equal.any(1), equal.argmax(1), SKETCHES) == band  # else met in an earlier bucket
    i, j = i[first], j[first]
    if not len(i):
        return
    own, theirs = ([np.frombuffer(t.as_py(), "<u4") for t in block.field("words")] for block in (x, y))
    counts = [np.array([np.bincount(t % BINS, minlength=BINS) for t in block], np.int32) for block in (own, theirs)]
    common = np.minimum(counts[0][i], counts[1][j]).sum(1)  # at least as many as words in common
    total = n[i, 0] + m[j, 0]
    enough = common >= SIMILARITY * (total - common)
    i, j = i[enough], j[enough]
    for k, o in zip(i.tolist(), j.tolist(), strict=True):
        if similarity(own[k], theirs[o]):
            yield k, o


def _open_members(known: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with outside (are they of another than the commonest
    class of their bucket) and the numbers of outsiders and insiders."""
    bucket = ["band", "value"]
    sizes = known.groupBy(*bucket, "label").agg(F.count("*").alias("n"))
    found = sizes.groupBy(*bucket).agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outsiders"), F.max("n").alias("insiders"))
    found = written(found.where("outsiders > 0"), "open")
    members = known.select(*bucket, "node", "n", "label").join(found.hint("merge"), bucket)
    return members.withColumn("outside", F.col("label") != F.col("main"))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [labelled(np.frombuffer(t.as_py(), "<u4").astype(np.uint64)).view(np.int64) for t in batch.column("words")]
        row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
        flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(row), batch.column("n").take(row), flat], names=["node", "n", "term"])


def _divided(members: DataFrame, rows: DataFrame) -> DataFrame:
    """members of large buckets in smaller ones: by bucket and rare word."""
    node = rows.schema["node"].dataType.simpleString()
    texts = rows.select("node", "n", "words").join(members.select("node").distinct(), "node", "left_semi")
    terms = written(_rarest(texts.mapInArrow(_word_rows, f"node {node}, n int, term long")).select("node", "term"), "rarest")
    met = members.select("band", "value", "node", "n", "label").join(terms, "node")
    return written(met.select("band", F.xxhash64("value", "term").alias("value"), "node", "n", "label"), "divided")


def _apart(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between members of one bucket that are still in different classes.

    The outsiders of a bucket (all but its commonest class) and the others form blocks of about BLOCK; every
    block of outsiders meets itself and every other block, so no pair is left out and only links are emitted.
    """
    bucket = ["band", "value"]
    known = known.withColumn("value", F.col("value").cast("long"))
    members = _open_members(known)
    large = members.where(F.col("outsiders") + F.col("insiders") > LARGE)
    members = members.where(F.col("outsiders") + F.col("insiders") <= LARGE)
    if not large.isEmpty():
        members = members.unionByName(_open_members(_divided(large, rows)))
    members = members.join(rows.select("node", "sketches", "words"), "node")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.when(F.col("outside"), F.col("outsiders")).otherwise(F.col("insiders")) / BLOCK)).alias("part")
    blocks = members.select(*bucket, "outside", part, F.struct("node", "n", "label", "sketches", "words").alias("o"))
    blocks = written(blocks.groupBy(*bucket, "outside", "part").agg(F.collect_list("o").alias("block")), "blocks")
    left = blocks.where("outside").select(*bucket, F.col("part").alias("p"), F.col("block").alias("left"))
    right = blocks.select(*bucket, "outside", "part", F.col("block").alias("right"))
    met = left.join(right.hint("merge"), bucket).where("NOT outside OR p <= part").select("band", F.expr("outside AND p = part").alias("same"), "left", "right")
    node = known.schema["node"].dataType.simpleString()
    return written(met.mapInArrow(_compare, f"a {node}, b {node}").distinct(), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, n_links, and `first`: is it the one to keep."""
    node = F.struct(*document_key(F.col(doc_id), F.col(text)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), node.alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _classes(rows)


def _classes(rows: DataFrame) -> DataFrame:
    digests = rows.select("doc_id", "node", F.md5("text").alias("digest"), F.col("text").rlike("[^ \\t-\\r]").alias("worded"))
    digests = written(digests, "digests")
    groups = digests.where("worded").groupBy("digest").agg(F.min("node").alias("lead"), F.count("*").alias("n"))
    copied = written(groups.where("n > 1").select("digest", "lead"), "copied")
    led = attach(digests, copied, ["digest"], "left").withColumn("lead", F.when(F.col("worded"), F.coalesce("lead", "node")).otherwise(F.col("node")))
    led = written(led.select("doc_id", "node", "lead"), "led")
    copies = written(led.where("node != lead").select("node").distinct(), "copies")
    unlike = attach(rows.select("node", "text"), copies, ["node"], "left_anti")
    links, labels = linked(unlike)
    ends = links.select(F.explode(F.array("a", "b")).alias("lead")).groupBy("lead").agg(F.count("*").alias("n_links"))
    classes = labels.select(F.col("node").alias("lead"), "label").join(ends, "lead", "left")
    known = attach(led, written(classes, "classes"), ["lead"], "left").withColumn("label", F.coalesce("label", "lead"))
    sizes = known.groupBy("label").agg(F.count("*").alias("class_size"), F.min("node").alias("keep"))
    several = written(sizes.where("class_size > 1"), "sizes")
    out = attach(known, several, ["label"], "left")
    return out.select(
        "doc_id",
        original_id(F.coalesce("keep", "node")["doc"], F.coalesce("keep", "node")["tie"]).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("keep", "node") == F.col("node")).alias("first"),
        "node",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each class of near duplicates."""
    with scratch(docs.sparkSession):
        kept = near_duplicates(docs, doc_id, text).where("first").groupBy("node").agg(F.count("*").alias("n"))
        kept = written(kept.select(F.col("node.doc").alias("doc"), F.col("node.tie").alias("tie"), "n"), "kept", lasting=True)
    rows = docs.select(F.struct("*").alias("row"), *document_key(F.col(doc_id), F.col(text)))
    once = attach(rows, kept, ["doc", "tie"], "inner")
    if not kept.where("n > 1").isEmpty():  # the same row several times
        once = once.where("n = 1").unionByName(once.where("n > 1").groupBy("doc", "tie").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", "doc", "tie", F.lit(1).alias("n")))
    return once.select("row.*")
