"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to 1 as they can (in relative entropy) while each source's words meet its
target: rate = min(CAP, exp(l * size / mean size)), one multiplier l for each source. The multipliers solve
the convex dual by Newton steps, kept inside a bracket; every step is one aggregation over (source, size)
counts. Rates are then rounded into whole copies: a document's next copy is drawn where its place, a hash of
its identifier, lies under the fraction of its rate plus a shift, and the shift of each source is refined
until the words drawn meet the target. Shorter documents then fill what is left, the largest that fit first, until
in no source a document that could still be drawn is as short as what is left; one fold over the sizes of a
source decides how many of each. Where a drawn document is a little shorter than the least one left, that one
takes its place.

Only DataFrame functions are used; sources live in a DataFrame, so their number is not bounded by the driver.
One small row a source is ordered in one task, since targets follow the order of sources.

Defined results: null texts have size 0 and rate 1 at most (they take no words); a null source is a source of
its own, last in order; rows equal in doc_id, text and source share one place and are drawn together; very long texts are counted whole
and are left out where they exceed what their source still needs; an empty table gives an empty result; only the
named columns are read, so other columns don't clash. A source whose target is 0 is left out, one whose target
is CAP times its size is taken CAP times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm._session import attach, document_key, scratch, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
STEPS = 40
UNROLLED = 4  # Newton steps in one job
TOLERANCE = 1e-9
LEVELS, BINS = 2, 65_536
LARGEST = 60.0  # of an exponent


def size(text: Column) -> Column:
    """Words of a text: runs other than blanks."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): `share` of all words dealt by weight, no source above `cap` times its size.

    Sources are full in the order of size over weight, so running sums find the level of the others.
    """
    sums = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    in_order = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source
    turn = (F.row_number().over(in_order) - 1) % len(weights) + 1
    weighted = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    room = weighted.withColumn("room", cap * F.col("source_size")).withColumn("full_at", F.col("room") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = room.withColumn("left", share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    levels = levels.withColumn("level", F.col("left") / F.sum("weight").over(from_here))
    open_ = F.col("level") < F.col("full_at")
    level = F.min(F.when(open_, F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("target", F.least(F.col("room"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def multipliers(counts: DataFrame, wanted: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(source, scale, l): the dual solution of each source, by Newton steps over (source, size, n) counts."""
    counts = counts.where("size > 0")
    scale = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = wanted.join(scale, _same_source(wanted, scale)).select(wanted["source"], "source_size", "target", "scale")
    span = F.lit(LARGEST)
    state = state.select("*", F.lit(0.0).alias("l"), (-span).alias("low"), span.alias("high"), F.lit(False).alias("done"))
    state = written(state, "dual")
    for step in range(1, steps + 1):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.exp(F.greatest(-span, F.least(span, F.col("l") * x))), F.lit(cap))
        rows = counts.join(state.withColumnRenamed("source", "s"), _same("source", "s"))
        kept = [F.first(c).alias(c) for c in ("source_size", "target", "scale", "l", "low", "high", "done")]  # one value a source
        moved = rows.groupBy("source").agg(
            F.sum(rate * F.col("size") * F.col("n")).alias("taken"),
            F.sum(F.when(rate < cap, rate * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"),
            *kept,
        )
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("l")).otherwise(F.col("low")), F.when(gap > 0, F.col("l")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("l") - gap / F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        state = moved.select(
            "source", "source_size", "target", "scale",
            F.when(done, F.col("l")).when(inside, newton).otherwise((low + high) / 2).alias("l"),
            F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"),
            done.alias("done"),
        )
        if step % UNROLLED == 0:
            state = written(state, "dual")
            if state.where("NOT done").isEmpty():
                break
    return state.select("source", "scale", "l")


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _bin(place: Column, low: Column, width: Column) -> Column:
    return F.floor((place - low) / width * BINS)


def shifts(rated: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """(source, gap, shift): documents with place < shift get their next copy, and gap words are then missing.

    Drawing stops before the document with which the words drawn would exceed what the source needs. Each level counts
    words in BINS equal bins of an interval and goes on with the bin in which their running sum exceeds the need.
    """
    have = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("have"))
    have = wanted.join(have.withColumnRenamed("source", "s"), _same("source", "s"), "left")
    state = have.select("source", (F.col("target") - F.coalesce("have", F.lit(0))).alias("need"), F.lit(-1.0).alias("low"), F.lit(2.0).alias("width"))
    state = written(state, "shift")
    open_ = rated.where((F.col("whole") < limit) & (F.col("size") > 0)).select("source", "size", "place")
    for _ in range(LEVELS):
        bounds = state.select(F.col("source").alias("s"), F.col("low").alias("l"), F.col("width").alias("w"))
        binned = open_.join(bounds, _same("source", "s")).withColumn("bin", _bin(F.col("place"), F.col("l"), F.col("w"))).where((F.col("bin") >= 0) & (F.col("bin") < BINS))
        binned = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows a source
        summed = binned.withColumn("upto", F.sum("words").over(run)).withColumnRenamed("source", "s")
        # without a bin that exceeds the need, all of the interval is drawn
        passed = summed.join(state, _same("source", "s")).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("need"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("p"), F.sum("words").alias("all")
        )
        moved = state.join(passed.withColumnRenamed("source", "s"), _same("source", "s"), "left")
        state = moved.select(
            "source",
            (F.col("need") - F.coalesce("p.before", "all", F.lit(0))).alias("need"),
            (F.col("low") + F.coalesce("p.bin", F.lit(BINS)) * F.col("width") / BINS).alias("low"),
            (F.col("width") / BINS).alias("width"),
        )
        state = written(state, "shift")
    return state.select("source", F.col("need").alias("gap"), F.col("low").alias("shift"))


def fillings(open_: DataFrame, drawn: DataFrame) -> DataFrame:
    """(source, taken, given): how many documents of which size fill the gap of each source, as arrays of (size, n).

    open_ has (source, size, gap) of the documents not drawn, drawn (source, size, place) of the others. Sizes are taken
    from the largest that fits downward, of each as many documents as fit, so the gap falls below the least size that is
    left. If a drawn document is shorter than that by at most the gap, the shortest such (size, place) is given for it.
    A source has at most as many sizes as its longest document has words, and takes of at most sqrt(2 * gap) of them.
    """
    sizes = open_.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    sizes = sizes.groupBy("source").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))

    def step(state: Column, x: Column) -> Column:
        n = F.greatest(F.lit(0), F.least(x["n"], F.floor(state["gap"] / x["size"]).cast("long")))
        more = F.array(F.struct(x["size"].alias("size"), n.alias("n")))
        taken = F.when(n > 0, F.concat(state["t"], more)).otherwise(state["t"])
        return F.struct((state["gap"] - n * x["size"]).alias("gap"), taken.alias("t"), F.when(n < x["n"], x["size"]).otherwise(state["least"]).alias("least"))

    none = F.array().cast("array<struct<size:bigint,n:bigint>>")
    start = F.struct(F.col("gap").alias("gap"), none.alias("t"), F.lit(None).cast("long").alias("least"))
    state = sizes.select("source", F.aggregate("sizes", start, step).alias("f"))
    held = drawn.groupBy("source", "size").agg(F.max("place").alias("place"))
    held = held.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("size", "place"))).alias("drawn"))
    both = state.join(held, _same("source", "s"), "left")
    given = F.get(F.filter("drawn", lambda x: (x["size"] < F.col("f.least")) & (x["size"] >= F.col("f.least") - F.col("f.gap"))), 0)
    both = both.withColumn("given", given)
    last = F.when(F.col("given").isNotNull(), F.array(F.struct(F.col("f.least").alias("size"), F.lit(1).cast("long").alias("n")))).otherwise(none)
    return both.select("source", F.concat("f.t", last).alias("taken"), "given")


def filled(rated: DataFrame, shift: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(source, size, until): documents not yet drawn with place <= until fill what is left; and (source, given), a
    document of each source that is drawn no more."""
    rows = _with(rated, shift).where((F.col("whole") < limit) & (F.col("size") > 0)).select("source", "size", "place", "gap", (F.col("place") < F.col("shift")).alias("drawn"))
    rows = written(rows, "fitting")
    found = written(fillings(rows.where("NOT drawn"), rows.where("drawn")), "fillings")
    wanted = found.select(F.col("source").alias("s"), F.inline("taken")).groupBy("s", F.col("size").alias("words")).agg(F.sum("n").alias("n"))
    chosen = rows.where("NOT drawn").join(wanted, _same("source", "s") & (F.col("size") == F.col("words"))).select("source", "size", "place", "n")
    # the places up to the bin that holds the last one wanted, then their exact order
    bins = chosen.groupBy("source", "size", _bin(F.col("place"), F.lit(-1.0), F.lit(2.0)).alias("bin")).agg(F.count("*").alias("m"), F.first("n").alias("n"))
    run = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    last = bins.withColumn("upto", F.sum("m").over(run)).where(F.col("upto") >= F.col("n")).groupBy("source", "size").agg(F.min("bin").alias("last"))
    last = last.withColumnsRenamed({"source": "s", "size": "words"})
    near = chosen.join(last, _same("source", "s") & (F.col("size") == F.col("words"))).where(_bin(F.col("place"), F.lit(-1.0), F.lit(2.0)) <= F.col("last"))
    ties = Window.partitionBy("source", "size").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    fits = near.withColumn("upto", F.count("*").over(ties)).where(F.col("upto") <= F.col("n"))
    return fits.groupBy("source", "size").agg(F.max("place").alias("until")), found.select("source", "given")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies and the rate they round."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), document_key(F.col(doc_id), F.col(text))[1], F.col(source).alias("source"), size(F.col(text)).alias("size"))
    rows = written(rows, "sizes")
    wanted = written(targets(rows, cap=cap), "targets")
    counts = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    solved = multipliers(counts, wanted, cap)
    plan = written(wanted.join(solved.withColumnRenamed("source", "s"), _same("source", "s"), "left").drop("s"), "plan")
    known = _with(rows, plan)
    limit = int(cap)
    rate = F.least(F.exp(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("l") * F.col("size") / F.col("scale")))), F.lit(cap))
    full = F.col("target") >= cap * F.col("source_size")
    rate = F.when(full, F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.coalesce(rate, F.lit(1.0)))
    draw = (F.pmod(F.xxhash64("doc_id", "tie", F.lit("mix")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rated = known.withColumn("rate", rate).withColumn("whole", F.least(F.floor("rate"), F.lit(limit)))
    rated = rated.withColumn("place", draw - (F.col("rate") - F.col("whole")))
    rated = written(rated.select("doc_id", "tie", "source", "size", "source_size", "target", "rate", "whole", "place"), "rates")
    shift = shifts(rated, wanted, limit)
    until, given = filled(rated, shift, limit)
    until = written(until.select(_source_key("source").alias("source_key"), "size", "until"), "until")
    moved = shift.join(given.withColumnRenamed("source", "s"), _same("source", "s"), "left").drop("s")
    rows = attach(_with(rated, moved).withColumn("source_key", _source_key("source")), until, ["source_key", "size"])
    fills = (F.col("place") >= F.col("shift")) & (F.col("place") <= F.col("until"))
    gone = (F.col("size") == F.col("given.size")) & (F.col("place") == F.col("given.place"))
    true = lambda c: F.coalesce(c, F.lit(False))
    drawn = (F.col("whole") < limit) & (F.col("size") > 0) & (((F.col("place") < F.col("shift")) & ~true(gone)) | true(fills))
    out = rows.withColumn("copies", (F.col("whole") + drawn.cast("int")).cast("int"))
    return out.select("doc_id", "tie", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def _with(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns of their source, null sources included."""
    right = written(by_source.select(_source_key("source").alias("source_key"), *[c for c in by_source.columns if c != "source"]), "by-source")
    return attach(rows.withColumn("source_key", _source_key("source")), right, ["source_key"]).drop("source_key")


def _source_key(source: str) -> Column:
    return F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with all their columns.

    Rows equal in doc_id, text and source are taken equally often. Null texts and texts without words are never taken;
    an empty table gives an empty one; columns of any name stay as they are.
    """
    key = document_key(F.col("doc_id"), F.col("text"))
    with scratch(docs.sparkSession):
        copies = mix(docs).where("copies > 0").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "tie", _source_key("source").alias("source_key"), "copies").distinct()
        copies = written(copies, "copies", lasting=True)
    rows = docs.select(F.struct("*").alias("row"), *key, _source_key("source").alias("source_key"))
    taken = attach(rows, copies, ["doc", "tie", "source_key"], "inner")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
