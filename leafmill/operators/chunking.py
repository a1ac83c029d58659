"""Pages and chunks: grouping, greedy packing and table splitting, all without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import let

MAX_CHARS = 2000
PAGE_LINES = 20
TABLE_RULE = r"^\s*\|?[\s:|-]+\|[\s:|-]*\|?\s*$"
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def pages(docs: DataFrame, key: str, text: str = "text", size: int = PAGE_LINES) -> DataFrame:
    """(key, page_no, label, text): `size` lines a page, in order, from 1."""
    all_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    numbered = docs.select(key, all_lines.alias("l")).select(key, "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int"))).alias("p"))
    body = F.array_join(F.slice("l", F.col("p") * size + 1, F.lit(size)), "\n")
    return numbered.select(key, (F.col("p") + 1).alias("page_no"), F.concat(F.lit("Page "), F.col("p") + 1).alias("label"), body.alias("text"))


def pages_of(docs: DataFrame, key: str, metadata: str = "metadata", text: str = "text") -> DataFrame:
    """(key, page_no, label, text) of documents whose metadata comes in either shape: a list `pages`, else a map
    `page_texts`, else the whole text as one page."""
    m = F.from_json(metadata, "pages array<struct<label:string,text:string>>, page_texts map<string,string>")
    mapped = F.transform(F.map_entries(m["page_texts"]), lambda e: F.struct(F.concat(F.lit("Page "), e["key"]).alias("label"), e["value"].alias("text")))
    whole = F.array(F.struct(F.lit("Document").alias("label"), F.col(text).alias("text")))
    shape = F.when(F.size(m["pages"]) > 0, m["pages"]).when(F.size(mapped) > 0, mapped).otherwise(whole)
    return docs.select(key, F.posexplode(shape).alias("page_no", "p")).select(key, "page_no", "p.label", "p.text")


def duplicates(pages_: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """pages_ (key, page_no, label, ...): a page whose fingerprint an earlier one of its document has takes over
    all columns of the first such page but number and label, and its label says so."""
    taken = [c for c in pages_.columns if c not in (key, "page_no", "label")]
    rows = pages_.withColumn("_fp", fingerprint)
    first = rows.groupBy(key, "_fp").agg(F.min_by(F.struct(F.col("page_no").alias("first"), *taken), "page_no").alias("_c"))
    label = F.when(F.col("_c.first") < F.col("page_no"), F.concat("label", F.lit(" (duplicate of Page "), "_c.first", F.lit(")"))).otherwise(F.col("label"))
    return rows.join(first, [key, "_fp"]).select(key, "page_no", label.alias("label"), *[F.col("_c")[c].alias(c) for c in taken])


def joined(df: DataFrame, keys: list[str], order: str, value: Column, separator: str, name: str = "text") -> DataFrame:
    """Values of each group in order, joined."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("x")).select(*keys, F.array_join(F.col("x.v"), separator).alias(name))


def merged(pages_: DataFrame, key: str) -> DataFrame:
    """One page stays as it is; several get headings and rules, joined by a blank line."""
    marked = F.concat(F.lit("---\n### "), F.col("label"), F.lit("\n\n"), F.col("text"))
    rows = pages_.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_no", F.col("text").alias("raw"), marked.alias("marked")))).alias("p"))
    return rows.select(key, F.when(F.size("p") == 1, F.col("p")[0]["raw"]).otherwise(F.array_join(F.col("p.marked"), "\n\n")).alias("text"))


def _packed(items: Column, limit: int, glue: str, taken: Column) -> Column:
    """Consecutive items joined to parts: an item starts a new part when the part would pass the limit.

    The fold carries lengths and where parts start; texts are joined once, after it.
    """

    def step(state: Column, n: Column) -> Column:
        fresh = (state["i"] == 0) | (state["at"] + len(glue) + n > limit)
        return F.struct(
            F.when(fresh, taken + n).otherwise(state["at"] + len(glue) + n).alias("at"),
            (state["i"] + 1).alias("i"),
            F.when(fresh, F.array_append(state["starts"], state["i"])).otherwise(state["starts"]).alias("starts"),
        )

    def parts(u: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(F.transform(u, lambda x: F.length(x)), begin, step, lambda s: s["starts"])
        until = lambda st, k: F.coalesce(F.get(st, k + 1), F.size(u))
        return let(starts, lambda st: F.transform(st, lambda s, k: F.array_join(F.slice(u, s + 1, until(st, k) - s), glue)))

    return let(items, parts)


def pack(units: Column, limit: int = MAX_CHARS, glue: str = "\n\n") -> Column:
    """Greedy packing: a unit starts a new part when it would push the current one over the limit."""
    return _packed(F.filter(units, lambda u: u != ""), limit, glue, F.lit(0))


def split_table(head: Column, rule: Column, rows: Column, limit: int = MAX_CHARS) -> Column:
    """Parts of whole rows, each within the limit if rows are, each with the header and the rule."""
    prefix = F.concat(head, F.lit("\n"), rule, F.lit("\n"))
    return F.transform(_packed(rows, limit, "\n", F.length(prefix)), lambda part: F.concat(prefix, part))


def units(pages_: DataFrame, keys: list[str], limit: int = MAX_CHARS) -> DataFrame:
    """(keys, units): the pieces of each page that packing may not cut, in order.

    A table, from a row with bars whose next line is a rule over all rows with bars, is one unit, or several of
    whole rows under its header if it alone exceeds the limit. Between tables the paragraphs are units.
    """
    in_page = Window.partitionBy(*keys).orderBy("pos")
    rows = pages_.select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("bar", F.contains("line", F.lit("|"))).withColumn("rule", F.col("line").rlike(TABLE_RULE))
    rows = rows.withColumn("head", F.col("bar") & F.coalesce(F.lead("rule").over(in_page), F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("bar"), 0).otherwise(1)).over(in_page))
    first = F.min(F.when(F.col("head"), F.col("pos"))).over(Window.partitionBy(*keys, "island"))
    rows = rows.withColumn("table", F.col("bar") & F.coalesce(F.col("pos") >= first, F.lit(False)))
    starts = F.coalesce(F.col("table") != F.lag("table").over(in_page), F.lit(True)) | (F.col("table") & (F.col("pos") == first))
    rows = rows.withColumn("segment", F.sum(starts.cast("int")).over(in_page))
    lines = F.sort_array(F.collect_list(F.struct("pos", "line")))["line"]
    parts = rows.groupBy(*keys, "segment").agg(F.first("table").alias("table"), lines.alias("l")).withColumn("whole", F.array_join("l", "\n"))
    cut = split_table(F.col("l")[0], F.col("l")[1], F.slice("l", 3, F.greatest(F.size("l") - 2, F.lit(0))), limit)
    fits = (F.length("whole") <= limit) | (F.size("l") <= 2)
    paragraphs = F.filter(F.split("whole", "\n\n"), lambda u: F.trim(F.translate(u, "\n\t\r", "   ")) != "")
    pieces = F.when(F.col("table"), F.when(fits, F.array("whole")).otherwise(cut)).otherwise(paragraphs)
    return parts.groupBy(*keys).agg(F.flatten(F.sort_array(F.collect_list(F.struct("segment", pieces.alias("u"))))["u"]).alias("units"))


def chunks(pages_: DataFrame, keys: list[str], limit: int = MAX_CHARS) -> DataFrame:
    """(keys, chunk_index, text): short pages whole, longer ones packed from their tables and paragraphs.

    Pages of fewer than 10 characters are left out; keys identify a page.
    """
    pages_ = pages_.where(F.length(F.trim("text")) >= 10)
    short = pages_.where(F.length("text") <= limit).select(*keys, F.lit(0).alias("chunk_index"), "text")
    packed = units(pages_.where(F.length("text") > limit), keys, limit).select(*keys, F.posexplode(pack(F.col("units"), limit)).alias("chunk_index", "text"))
    return short.unionByName(packed)
