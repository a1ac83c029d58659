"""Prefix trie of conversations by van Emde Boas recursion over depth.

All sequences of turns are cut at half depth; the cut prefixes are named; the upper trie and the lower forests are
cut at their own half depths in the same step, and so on until each piece is one turn deep. So a trie of depth D takes
log2(D) steps, however many pieces there are. Here the cuts stand at powers of two: a prefix of depth d is named by
the cut prefix at d less its lowest set bit, and by the block of turns between. Blocks are named from the bottom, two
halves at a time. No sequence is ever held in one row: a conversation of any length is rows of (conv_id, depth).

Totals are then grafted upward. A piece is the trie below a node as far as its next cut; its totals are those of its
upper half and of the lower halves that hang from it. Beyond its own piece a node of level k (the number of zero bits
its depth ends in) gets the totals of the nodes 2**k below it, which are of a higher level and were finished before.

Names are 128-bit digests of roles and texts; equal digests are taken for equal turns. Node (conv_id, depth), conv_id
being its smallest member, is unique.

Defined results: turns are ordered by turn (null first), turns with equal numbers by their digest; repeated rows are
turns of their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation. An empty table
has no nodes, not even a root. Very long texts are digested whole; other columns are not read. All exchanges deal
by (conv_id, depth) or by node; sums and least values are taken before the shuffle. Only the digest over the ends of
one node goes through one task, as a stream: a SHA-256 can't be divided.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm._session import written

ROOT = bytes(16)
ROOT_LEVEL = 62
#: Turns that a conversation may take over from another one, less one.
OPENING = 6
FAMILY = 100
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _joined(*names: Column) -> Column:
    return F.unhex(F.md5(F.concat(*names)))


def _level(depth: Column) -> Column:
    """The number of zero bits that depth ends in."""
    return F.when(depth == 0, F.lit(ROOT_LEVEL)).otherwise(F.bit_count(depth.bitwiseAND(-depth) - 1)).cast("int")


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, name, chars) of each turn, pos counting from 1. A conversation may spread over many tasks."""
    said, spoken = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    name = F.unhex(F.md5(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, spoken)))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), name.alias("name"), F.char_length(spoken).cast("long").alias("chars")
    )
    keys = ["conv_id", "turn", "name"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    pos = (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos")
    return written(placed.join(runs, ["conv_id", "part"]).select("conv_id", pos, "name", "chars"), "numbered")


def with_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences in which conversation c starts with the first h turns of c - c % FAMILY and goes on with its own turns
    after h, h being crc32(c) % OPENING; and the conversations, of which some may have no turn left."""
    convs = turns.select("conv_id").distinct()
    convs = written(convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % OPENING).alias("h")), "convs")
    heads = turns.where(F.col("pos") < OPENING).select(F.col("conv_id").alias("base"), "pos", "name", "chars")
    given = written(convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "name", "chars"), "openings")
    moved = given.groupBy("conv_id").agg(F.count("*").alias("m"))
    own = turns.join(convs.join(moved, "conv_id", "left"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("m", F.lit(0))).alias("pos"), "name", "chars")
    return written(given.unionByName(own), "sequences"), convs.select("conv_id")


def _cut_prefixes(sequences: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, name): the names of all prefixes."""
    blocks = [sequences.select("conv_id", (F.col("pos") - 1).alias("i"), "name")]
    for _ in range(1, levels):
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("above")).agg(half(0).alias("left"), half(1).alias("right"))
        pairs = pairs.where("left IS NOT NULL AND right IS NOT NULL")
        blocks.append(written(pairs.select("conv_id", F.col("above").alias("i"), _joined(F.col("left"), F.col("right")).alias("name")), "blocks"))
    named = None
    for block in reversed(blocks):
        ends = block.where("i % 2 = 0").select("conv_id", F.shiftright("i", 1).alias("a"), F.col("name").alias("block"))
        if named is None:
            named = written(ends.select("conv_id", (F.col("a") * 2 + 1).alias("a"), _joined(F.lit(ROOT), F.col("block")).alias("name")), "prefixes")
            continue
        cut = ends.join(named, ["conv_id", "a"], "left")
        cut = cut.select("conv_id", (F.col("a") * 2 + 1).alias("a"), _joined(F.coalesce("name", F.lit(ROOT)), F.col("block")).alias("name"))
        named = written(named.select("conv_id", (F.col("a") * 2).alias("a"), "name").unionByName(cut), "prefixes")
    return named.withColumnRenamed("a", "depth")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name", "level").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _grafted(up: DataFrame, own: DataFrame, levels: int) -> DataFrame:
    """(name, leaves, saved): totals of what is below each node.

    up (name, level, k, above, above_level): the node 2**k above each node, for all k up to its level. own (name,
    leaves, saved): what each node has itself.
    """
    to_above = lambda links, totals: links.join(totals, "name").select(F.col("above").alias("name"), F.col("above_level").alias("level"), "leaves", "saved")
    links = up.select("name", F.col("level").alias("own_level"), "k", "above", "above_level")
    piece = written(_summed(to_above(links.where("k = 0"), own)), "pieces")
    finished = []
    for j in range(levels):
        finished.append(piece.where(F.col("level") == j))
        hung = to_above(links.where((F.col("k") == j) & (F.col("own_level") == j)), piece.drop("level"))
        piece = written(_summed(piece.where(F.col("level") > j).unionByName(hung)), "pieces")
    total = piece.drop("level")  # of the root alone
    for k in reversed(range(levels)):
        rest = to_above(links.where((F.col("k") == k) & (F.col("own_level") > k)), total)
        total = total.unionByName(written(_summed(finished[k].unionByName(rest)).drop("level"), "totals"))
    return total


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the conv_ids of each run of equal names, carried from batch to batch."""
    schema = pa.schema([("name", pa.binary()), ("ends", pa.string())])
    name, digest = None, None
    for batch in batches:
        done = []
        for key, run in itertools.groupby(zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True), key=lambda x: x[0]):
            ids = ",".join([str(i) for _, i in run]).encode()
            if key == name:
                digest.update(b"," + ids)
                continue
            if name is not None:
                done.append({"name": name, "ends": digest.hexdigest()})
            name, digest = key, hashlib.sha256(ids)
        yield pa.RecordBatch.from_pylist(done, schema)
    if name is not None:
        yield pa.RecordBatch.from_pylist([{"name": name, "ends": digest.hexdigest()}], schema)


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of sequences (conv_id, pos, name, chars), one row a node; convs (conv_id) names also those without a turn.

    Result: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of the
    subtree (saved: a node's last text once for each member but one, in code points), ends_sha256 over the members
    that end here.
    """
    depth = sequences.agg(F.max("pos")).first()[0] or 0
    levels = int(depth).bit_length()
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
    if not levels:
        return _rows(root, root.select("name", "conv_id").limit(0), None, None, convs.select(F.lit(ROOT).alias("name"), "conv_id"))
    places = _cut_prefixes(sequences, levels).join(sequences.select("conv_id", F.col("pos").alias("depth"), "chars"), ["conv_id", "depth"])
    places = written(places.select("conv_id", "depth", "name", "chars"), "places")
    nodes = places.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = written(nodes.unionByName(root), "nodes")

    up = nodes.where("depth > 0").withColumn("level", _level(F.col("depth")))
    up = up.select("name", "conv_id", "level", "depth", F.explode(F.sequence(F.lit(0), "level")).alias("k"))
    up = up.withColumn("depth", F.col("depth") - F.expr("shiftleft(1L, k)"))
    up = up.join(places.select("conv_id", "depth", F.col("name").alias("above")), ["conv_id", "depth"], "left")
    up = written(up.select("name", "level", "k", F.coalesce("above", F.lit(ROOT)).alias("above"), _level(F.col("depth")).alias("above_level")), "up")

    parents = up.where("k = 0").select("name", "above")
    children = written(parents.groupBy(F.col("above").alias("name")).agg(F.count("*").alias("n_children")), "children")
    leaf = F.col("n_children").isNull().cast("long")
    own = nodes.join(children, "name", "left").select("name", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = written(own, "own")
    below = _grafted(up, own, levels)
    totals = own.unionByName(below).select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    known = parents.join(nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id")), "above").select("name", "parent_conv_id")

    lengths = sequences.groupBy("conv_id").agg(F.max("pos").alias("depth"))
    ends = lengths.join(places.select("conv_id", "depth", "name"), ["conv_id", "depth"]).select("name", "conv_id")
    ends = ends.unionByName(convs.join(lengths, "conv_id", "left_anti").select(F.lit(ROOT).alias("name"), "conv_id"))
    return _rows(nodes, known, children, totals, ends)


def _rows(nodes: DataFrame, parents: DataFrame, children: DataFrame | None, totals: DataFrame | None, ends: DataFrame) -> DataFrame:
    """All that is known of each node, met in one exchange."""
    digests = ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_end_digests, "name binary, ends string")
    rows = nodes.select("name", "conv_id", "depth", "n_convs")
    for part in (parents, children, totals, digests):
        if part is not None:
            rows = rows.unionByName(part, allowMissingColumns=True)
    for column in ("parent_conv_id", "n_children", "n_leaves", "saved_tokens"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("long"))
    met = rows.groupBy("name").agg(
        F.max("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"),
        F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return met.where("n_convs IS NOT NULL").drop("name")
