"""Markdown text to lines, tables, key-values, form blocks and sections, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: a field between bars.
META_FIELD = r"^\*{0,2}([^*:|]+):\*{0,2}\s*(.*)$"
META = r"\*\*([^*:]+):\*\*\s*(.*)"


def is_separator(line: Column) -> Column:
    """A table's rule: only blanks, bars, colons and dashes, with a dash."""
    return line.rlike(r"^[\s|:\-]+$") & line.contains("-")


def cells(line: Column) -> Column:
    """The trimmed cells of a table row."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def tables(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_start, rows): one row a table, its rows as structs (pos, line); the first is the header, rules are left out.

    A table starts at a row whose next line is a rule and goes on over rows with bars; text with bars before the header
    is not part of it. Each document is read by itself: no line is sorted or shuffled.
    """
    cut = docs.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("_l"))
    plain = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: ~F.contains(F.get("_l", i), F.lit("|")))
    cut = cut.select(key, "_l", F.concat(F.array(F.lit(-1)), plain, F.array(F.size("_l"))).alias("_b"))  # lines without bar
    after = lambda k: F.get("_b", k + 1)
    wide = F.filter(F.sequence(F.lit(0), F.size("_b") - 2), lambda k: after(k) - F.get("_b", k) > 1)
    run = lambda k: F.struct(
        (F.get("_b", k) + 1).alias("_start"), F.slice("_l", F.get("_b", k) + 2, after(k) - F.get("_b", k) - 1).alias("_lines"), F.coalesce(is_separator(F.get("_l", after(k))), F.lit(False)).alias("_next")
    )
    runs = cut.select(key, F.inline(F.transform(wide, run)))
    runs = runs.select(key, "_start", "_lines", F.array_append(F.transform("_lines", is_separator), F.col("_next")).alias("_rules"))
    heads = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: ~F.get("_rules", i) & F.get("_rules", i + 1))
    runs = runs.withColumn("_head", F.array_min(heads)).where("_head IS NOT NULL")
    numbered = F.transform("_lines", lambda x, i: F.struct((F.col("_start") + i).alias("pos"), x.alias("line")))
    # no lambda names _head: Spark would find the header anew for each line
    kept = F.filter(F.slice(numbered, F.col("_head") + 1, F.size("_lines")), lambda r: ~is_separator(r["line"]))
    return runs.select(key, (F.col("_start") + F.col("_head")).alias("table_start"), kept.alias("rows"))


def table_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_start, row_no, pos, line, cells) of all tables; row 0 is the header, rules are left out."""
    rows = tables(docs, key, text).select(key, "table_start", F.posexplode("rows").alias("row_no", "r"))
    return rows.select(key, "table_start", "row_no", "r.pos", "r.line", cells(F.col("r.line")).alias("cells"))


def table_segments(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_start, n_rows, n_columns)."""
    widths = F.transform("rows", lambda r: F.size(cells(r["line"])))
    return tables(docs, key, text).select(key, "table_start", (F.size("rows") - 1).cast("long").alias("n_rows"), F.array_max(widths).alias("n_columns"))


def _fitted(row: Column, width: Column) -> Column:
    """Cells cut or padded with empty strings to a width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def _rows_under_heads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_start, heads, row_no, cells) of all rows, each with its table's header."""
    found = tables(docs, key, text).select(key, "table_start", cells(F.get("rows", F.lit(0))["line"]).alias("heads"), F.posexplode("rows").alias("row_no", "r"))
    return found.select(key, "table_start", "heads", "row_no", cells(F.col("r.line")).alias("cells"))


def table_cells(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_start, row_no, header, value): short rows are padded with empty strings."""
    body = _rows_under_heads(docs, key, text).where("row_no > 0")
    pairs = F.arrays_zip(F.col("heads").alias("header"), _fitted(F.col("cells"), F.size("heads")).alias("value"))
    return body.select(key, "table_start", "row_no", F.explode(pairs).alias("c")).select(key, "table_start", "row_no", "c.header", "c.value")


def repaired_rows(docs: DataFrame, key: str, text: str = "text", blank: str = "&nbsp;") -> DataFrame:
    """(key, table_start, row_no, line): rows fitted to the header's width, blank cells filled."""
    rows = _rows_under_heads(docs, key, text)
    filled = F.transform(_fitted(F.col("cells"), F.size("heads")), lambda c: F.when(c == "", blank).otherwise(c))
    return rows.select(key, "table_start", "row_no", F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |")).alias("line"))


def key_values(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name, value) of `**Name:** value` segments between bars; the last of equal names wins."""
    parts = lines(docs, key, text).select(key, "pos", F.posexplode(F.split("line", r"\|")).alias("part", "segment"))
    found = parts.where(F.col("segment").rlike(META))
    pairs = found.select(key, "pos", "part", F.trim(F.regexp_extract("segment", META, 1)).alias("name"), F.trim(F.regexp_extract("segment", META, 2)).alias("value"))
    return pairs.groupBy(key, "name").agg(F.max_by("value", F.struct("pos", "part")).alias("value"))


def is_meta_line(line: Column) -> Column:
    """Are all segments of a line between bars `Label: value` fields?"""
    return F.forall(F.split(line, r"\|"), lambda part: F.trim(part).rlike(META_FIELD))


def is_section_heading(line: Column) -> Column:
    """A line that is one bold text without colon or bar."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    marks = (F.length(s) - F.length(F.replace(s, F.lit("**"), F.lit("")))) / 2
    return F.startswith(s, F.lit("**")) & F.endswith(s, F.lit("**")) & (marks == 2) & ~s.rlike("[:|]")


def headings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, title) of the lines that are section headings."""
    found = lines(docs, key, text).where(is_section_heading(F.col("line")))
    return found.select(key, "pos", F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+$", ""), r"^\*\*|\*\*$", "").alias("title"))


def meta_fields(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, part, label, value) of the fields of all lines that consist of fields.

    Where a value is a field itself, as behind a section label, the inner one counts.
    """
    parts = lines(docs, key, text).where((F.trim("line") != "") & is_meta_line(F.col("line"))).select(key, "pos", F.posexplode(F.split("line", r"\|")).alias("part", "segment"))
    take = lambda c, k: F.trim(F.regexp_extract(c, META_FIELD, k))
    outer = parts.select(key, "pos", "part", take(F.trim("segment"), 1).alias("label"), take(F.trim("segment"), 2).alias("value"))
    nested = F.col("value").rlike(META_FIELD) & (take(F.col("value"), 1) != "")
    return outer.select(key, "pos", "part", F.when(nested, take(F.col("value"), 1)).otherwise(F.col("label")).alias("label"), F.when(nested, take(F.col("value"), 2)).otherwise(F.col("value")).alias("value"))


def other_text(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, part, value): what is in no table and no `**Name:** value` segment, trimmed, in order."""
    rows = lines(docs, key, text).select(key, "pos", F.trim("line").alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("|")))
    fields = F.contains("line", F.lit("**")) & F.contains("line", F.lit(":"))
    parts = rows.select(key, "pos", F.posexplode(F.when(fields, F.split("line", r"\|")).otherwise(F.array("line"))).alias("part", "segment"), fields.alias("fields"))
    plain = ~F.col("fields") | (F.size(F.split("segment", r"\*\*")) < 3)
    return parts.where(plain & (F.trim("segment") != "")).select(key, "pos", "part", F.trim("segment").alias("value"))


def form_blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block_start, n_fields, block): runs of consecutive `Label: Value` lines."""
    line = F.col("line")
    field = line.rlike(r"^[A-Za-z][^|:]{0,60}:\s*\S") & ~line.contains("|") & ~line.rlike(r"^\s*(#|[-*]\s)")
    rows = lines(docs, key, text).withColumn("field", field)
    rows = rows.withColumn("run", F.sum((~F.col("field")).cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    blocks = rows.where("field").groupBy(key, "run").agg(F.min("pos").alias("block_start"), F.count("*").alias("n_fields"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return blocks.select(key, "block_start", "n_fields", F.array_join(F.col("l.line"), "\n").alias("block"))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section_no, title, body): cut at `## ` headings; text before the first is `Summary`."""
    parts = docs.select(key, F.posexplode(F.split(text, r"\n(?=##\s)")).alias("section_no", "part"))
    titled = F.col("part").rlike(r"^##\s")
    title = F.when(titled, F.trim(F.regexp_extract("part", r"^##\s+([^\n]*)", 1))).otherwise("Summary")
    body = F.when(titled, F.trim(F.regexp_replace("part", r"^##\s[^\n]*\n?", ""))).otherwise(F.trim("part"))
    return parts.select(key, "section_no", title.alias("title"), body.alias("body")).where((F.col("body") != "") | titled)


def as_json(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, json): {metadata{}, tables[[{}]], text[]} of each document."""
    meta = key_values(docs, key, text).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    found = tables(docs, key, text).select(key, "table_start", "rows", cells(F.get("rows", F.lit(0))["line"]).alias("heads")).where(F.size("rows") > 1)
    named = lambda r: F.to_json(F.map_from_arrays(F.col("heads"), _fitted(cells(r["line"]), F.size("heads"))))
    body = F.transform(F.slice("rows", F.lit(2), F.size("rows") - 1), named)
    held = found.select(key, "table_start", body.alias("rows")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("table_start", "rows"))).alias("t"))
    other = other_text(docs, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "part", "value")))["value"].alias("text"))
    joined = docs.select(key).join(meta, key, "left").join(held, key, "left").join(other, key, "left")
    return joined.select(key, F.to_json(F.struct("metadata", F.col("t.rows").alias("tables"), F.coalesce("text", F.array()).alias("text"))).alias("json"))


def as_long(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, row_no, header, value): form fields, table cells, other text and raw lines of each document."""
    cells = table_cells(docs, key, text).select(key, F.lit("table").alias("section"), "row_no", "header", "value")
    form = key_values(docs, key, text).select(key, F.lit("form").alias("section"), F.lit(0).alias("row_no"), F.col("name").alias("header"), "value")
    other = other_text(docs, key, text).select(key, F.lit("other").alias("section"), F.col("pos").alias("row_no"), F.lit("text").alias("header"), "value")
    raw = lines(docs, key, text).select(key, F.lit("raw").alias("section"), F.col("pos").alias("row_no"), F.lit("line").alias("header"), F.col("line").alias("value"))
    return cells.unionByName(form).unionByName(other).unionByName(raw)


def export_long(docs: DataFrame, key: str, path: str, text: str = "text") -> None:
    """Write the long form as CSV, one folder for each section."""
    as_long(docs, key, text).write.partitionBy("section").option("header", True).option("escape", '"').csv(path)


def doc_blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block_no, kind, title, lines): key-value, table, section and text blocks in order.

    A blank line ends every block. A line of several cells belongs to the table of its run of such lines (rules
    between them don't count; a table of one line is text). A line that ends in its only colon starts a section,
    which takes all lines up to the next blank line or table. Else `key: value` lines are key-value blocks, and
    what is left is text.
    """
    in_order = Window.partitionBy(key).orderBy("pos")
    line = F.col("t")
    rows = lines(docs, key, text).withColumn("t", F.trim("line")).where(~(F.contains("t", F.lit("|")) & F.col("t").rlike(r"^[|\-\s]+$")))
    full = F.filter(F.split(line, r"\|"), lambda c: F.trim(c) != "")
    row = F.contains(line, F.lit("|")) & (F.size(full) > 1)
    title = line.rlike(r"^[^:]+:$") & ~row
    blank = line == ""
    rows = rows.withColumn("row", row & ~blank)
    lone = ~F.coalesce(F.lag("row").over(in_order), F.lit(False)) & ~F.coalesce(F.lead("row").over(in_order), F.lit(False))
    rows = rows.withColumn("table", F.col("row") & ~lone).withColumn("head", title)
    # a section lasts from its title to the next blank line, table or title
    rows = rows.withColumn("stretch", F.sum((blank | F.col("row") | title).cast("int")).over(in_order))
    opened = F.first("head").over(Window.partitionBy(key, "stretch").orderBy("pos"))
    pair = line.rlike(r"^[^:]*[^:\s][^:]*:\s*\S") & ~F.col("row")
    kind = F.when(blank, None).when(F.col("table"), "table").when(opened, "section").when(pair, "key-value").otherwise("text")
    rows = rows.withColumn("kind", kind)
    fresh = ~F.col("kind").eqNullSafe(F.lag("kind").over(in_order)) | F.col("head") | (F.col("kind").isin("text", "section") & F.col("row"))
    rows = rows.withColumn("block", F.sum(fresh.cast("int")).over(in_order)).where("kind IS NOT NULL")
    made = rows.groupBy(key, "block", "kind").agg(
        F.max(F.when(F.col("head"), F.regexp_replace("t", r"\s*:$", ""))).alias("title"),
        F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "t"))))["t"].alias("lines"),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1
    return made.select(key, number.alias("block_no"), "kind", "title", "lines")
