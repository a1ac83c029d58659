"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for credential shapes; each match becomes a span (kind, start, end) and a candidate
hash of its value. Candidates are counted over the whole corpus by distinct repositories (documents) and
distinct owners (sources). A value that several owners hold is a widely copied example; one that a single
owner holds looks live. Base kinds (assign, access, hex) are always reported; the wider kind `opaque`
(long tokens of letters and digits that no base span overlaps) is added only where its value looks live.

Only DataFrame functions are used. Positions come from running sums over the lengths of matches and of the
text between them, CHUNK matches at a time, so the work grows with the matches of a text and not with their
square; spans count code points and exclude their end. Values are hashed (SHA-256) in the scan; no value is
written.

Defined results: null and empty texts have no spans; very long texts are scanned whole; a null owner is an owner
of its own; repeated rows with equal doc_id and text are one repository and get equal rows; an empty table gives
an empty result; only the named columns are read, so other columns don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._session import attach, document_key, written

#: The patterns of the base kinds, in their order, and the least length of their value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"\b(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}\b"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "opaque")
BASE = 3
KEY = ["doc", "tie"]
CHUNK = 256  # matches
MAX_OWNERS = 1  # of a live-looking value


def _chunks(items: Column) -> Column:
    """A non-empty array in slices of CHUNK."""
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _sums(steps: Column, start: Column) -> Column:
    """start, then start plus the first step, plus the second, and so on without the last."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        steps, F.struct(start.alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"]
    )


def _places(lengths: Column) -> Column:
    """(start, end) of each match from the (gap before, length) of all: sums of chunks, then inside chunks."""
    parts = _chunks(lengths)
    whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x["gap"] + x["m"]))
    starts = _sums(whole, F.lit(0))
    inside = lambda part, at: F.zip_with(part, _sums(F.transform(part, lambda x: x["gap"] + x["m"]), at), lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["m"]).alias("end")))
    return F.flatten(F.zip_with(parts, starts, inside))


def _spans(text: Column, pattern: str, kind: str, value_group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, kind, hash of the value), failing ones dropped."""
    match = F.lit(pattern)
    found = F.regexp_extract_all(text, match, F.lit(0))
    values = F.regexp_extract_all(text, match, F.lit(value_group)) if value_group else found
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("m")))
    places = _places(F.slice(lengths, 1, F.size(found)))
    span = lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.when(F.length(v) >= least, F.sha2(v, 256)).alias("value_hash"))
    kept = F.filter(F.zip_with(places, values, span), lambda r: r["value_hash"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value_hash:string>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def _free(wider: Column, base: Column) -> Column:
    """The wider matches that no base match overlaps; base matches are looked through by chunk."""
    parts = F.transform(_chunks(F.array_sort(base)), lambda p: F.struct(p.alias("p"), F.array_min(p["start"]).alias("low"), F.array_max(p["end"]).alias("high")))
    meets = lambda w: F.exists(parts, lambda c: (c["low"] < w["end"]) & (w["start"] < c["high"]) & F.exists(c["p"], lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return F.when((F.size(wider) == 0) | (F.size(base) == 0), wider).otherwise(F.filter(wider, lambda w: ~meets(w)))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, doc, tie, owner, spans): all matches of all kinds in each whole text, in order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [(ASSIGN, "assign", 2, ASSIGN_LEAST), (ACCESS, "access", 0, 0), (HEX, "hex", 0, 0), (OPAQUE, "opaque", 0, 0)]
    base = F.concat(*[_spans(whole, *k) for k in kinds[:BASE]])
    rows = docs.select(F.col(doc_id).alias("doc_id"), *document_key(F.col(doc_id), F.col(text)), F.col(owner).alias("owner"), base.alias("base"), _spans(whole, *kinds[BASE]).alias("wider"))
    return rows.select("doc_id", *KEY, "owner", F.array_sort(F.concat("base", _free(F.col("wider"), F.col("base")))).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners) of every candidate value, counted in two steps.

    The first step folds the repositories of one owner, so a value that a third of all rows hold
    is combined on the map side and never meets in one task as rows.
    """
    each = found.select(*KEY, "owner", F.explode("spans.value_hash").alias("value_hash"))
    pairs = each.groupBy("value_hash", "owner", *KEY).agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, end, kind, live), base kinds complete."""
    found = written(candidates(docs, doc_id, text, owner), "candidates")
    counts = ownership(found.where(F.size("spans") > 0))
    single = written(counts.where(F.col("n_owners") <= max_owners).select("value_hash", F.lit(True).alias("live")), "live")
    flat = found.where(F.size("spans") > 0).select(*KEY, F.explode("spans").alias("s")).withColumn("value_hash", F.col("s.value_hash"))
    judged = attach(flat, single, ["value_hash"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    shown = judged.where((F.col("s.kind") < BASE) | F.col("live"))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), "live")
    spans = written(shown.groupBy(*KEY).agg(F.array_sort(F.collect_set(span)).alias("shown")), "spans")
    out = attach(found.select("doc_id", *KEY), spans, KEY, "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:int,live:boolean>>")
    return out.select("doc_id", F.coalesce("shown", none).alias("spans"))


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, then how many base spans hold live-looking values."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(_named(base), 256).alias("base_sha256"),
        _named(spans).alias("spans"),
        F.size(F.filter(base, lambda s: s["live"])).cast("long").alias("n_live"),
    )
