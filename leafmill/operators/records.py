"""Order-aware consolidation of per-chunk records, completeness, timelines, rendering and prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import is_blank, parse_date
from leafmill.operators.sized import if_small


def consolidate_scalars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, chunk, value): the last value that is not blank wins."""
    return rows.where(~is_blank(F.col("value"))).groupBy(*keys).agg(F.max_by("value", "chunk").alias("value"))


def consolidate_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, chunk, value array): distinct items that say something, in order of first appearance."""
    items = rows.select(*keys, "chunk", F.posexplode("value").alias("pos", "item")).where(F.col("item").isNotNull() & (F.col("item") != ""))
    first = items.groupBy(*keys, "item").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("x")).select(*keys, F.col("x.item").alias("value"))


def consolidate_maps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, chunk, value map): per inner key the last value that is not null. Long form (keys, name, value)."""
    inner = rows.select(*keys, "chunk", F.explode("value").alias("name", "v")).where(F.col("v").isNotNull())
    return inner.groupBy(*keys, "name").agg(F.max_by("v", "chunk").alias("value"))


def consolidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, chunk, kind, scalar, list, map): deep merge where the kind of a key may change.

    A scalar that says something overwrites what was there; a map over another kind starts anew; a list
    over another kind is ignored. So per key only what follows the last overwriting chunk counts.
    """
    says = (F.col("kind") == "scalar") & ~is_blank(F.col("scalar"))
    last_scalar = F.max(F.when(says, F.col("chunk")))
    marks = rows.groupBy(*keys).agg(
        last_scalar.alias("s"),
        F.max(F.when(F.col("kind") == "map", F.col("chunk"))).alias("m"),
        F.min(F.when((F.col("kind") == "list") | (F.col("kind") == "map") | says, F.struct("chunk", "kind"))).alias("first"),
    )
    state = F.when(F.col("m").isNotNull() & (F.col("s").isNull() | (F.col("m") > F.col("s"))), "map").when(F.col("s").isNotNull(), "scalar").otherwise(F.col("first.kind"))
    known = rows.join(marks.withColumn("state", state), keys)
    scalars = consolidate_scalars(known.where("state = 'scalar' AND kind = 'scalar'").withColumn("value", F.col("scalar")), keys)
    lists = consolidate_lists(known.where("state = 'list' AND kind = 'list'").withColumn("value", F.col("list")), keys)
    maps = consolidate_maps(known.where("state = 'map' AND kind = 'map' AND (s IS NULL OR chunk > s)").withColumn("value", F.col("map")), keys)
    return (
        scalars.select(*keys, F.lit("scalar").alias("kind"), F.lit("").alias("name"), "value")
        .unionByName(lists.select(*keys, F.lit("list").alias("kind"), F.lit("").alias("name"), F.to_json("value").alias("value")))
        .unionByName(maps.select(*keys, F.lit("map").alias("kind"), "name", "value"))
    )


def _filled(kind: Column, value: Column, items: Column) -> Column:
    """Does a field of a record say something? Structured values are JSON: maps of items, rows of a table."""
    marks = F.from_json(value, "map<string,string>")
    asked = lambda ok: F.exists(items, lambda i: F.coalesce(ok(F.element_at(marks, i)), F.lit(False)))
    return (
        F.when(kind == "checkbox", is_marked(value))
        .when(kind == "checklist", asked(is_marked))
        .when(kind == "checklist_kv", asked(lambda v: ~is_blank(v)))
        .when(kind == "table", F.size(F.from_json(value, "array<map<string,string>>")) > 0)
        .otherwise(~is_blank(value))
    )


def is_marked(state: Column) -> Column:
    return F.coalesce(F.lower(state).isin("checked", "unchecked"), F.lit(False))


def completeness(records: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """records (key, name, value), fields (name, type, items): (key, total, filled, blank) over all fields.

    A checkbox counts only if checked or unchecked, a checklist if one of its items is, a list of keys and
    values if one of its items has a value, a table if it has a row. A field that a record names twice counts twice.
    """
    filled = _filled(F.col("type"), F.col("value"), F.coalesce("items", F.array().cast("array<string>")))
    met = records.join(if_small(fields.withColumn("_known", F.lit(True))), "name", "left")
    names = met.groupBy(key, "name").agg(F.count("_known").alias("n"), F.count_if(F.coalesce(F.col("_known") & filled, F.lit(False))).alias("filled"))
    again = F.sum(F.greatest(F.col("n") - 1, F.lit(0)))
    size = fields.agg(F.count("*").alias("fields"))  # one row
    counts = names.groupBy(key).agg(again.alias("again"), F.sum("filled").alias("filled")).crossJoin(F.broadcast(size))
    return counts.select(key, (F.col("fields") + F.col("again")).alias("total"), "filled").withColumn("blank", F.col("total") - F.col("filled"))


def timeline(events: DataFrame, key: str) -> DataFrame:
    """events (key, date, event): distinct dated lines in order of time, undated ones last; (key, timeline)."""
    rows = events.where((F.trim("date") != "") & (F.trim("event") != "")).select(key, "date", "event").distinct()
    rows = rows.withColumn("at", parse_date(F.col("date")))
    item = F.struct(F.col("at").isNull().alias("late"), "at", "date", "event")
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("l"))
    line = lambda x: F.concat(F.lit("- "), F.when(x["late"], F.concat(x["date"], F.lit(" (unknown)"))).otherwise(x["date"]), F.lit(": "), x["event"])
    return lists.select(key, F.array_join(F.transform("l", line), "\n").alias("timeline"))


BOXES = {"checked": "☑", "unchecked": "☐"}
MISSING = "—"
YEAR_BITS = 16  # ages and thresholds count up to this many bits of whole years
MOST_YEARS = 2**YEAR_BITS - 2


def render(records: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """(key, markdown): fields (section, pos, name, label, type, items) of a record, blank ones and empty sections
    left out. Checklists and tables render their items; for a table, items are its columns."""
    rows = records.join(if_small(fields), "name").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    shown = rows.where(F.coalesce(_filled(F.col("type"), F.col("value"), F.col("items")), F.lit(False)))
    head = F.concat(F.lit("- **"), F.col("label"), F.lit(":**"))
    box = lambda state: F.when(F.lower(state) == "checked", BOXES["checked"]).otherwise(BOXES["unchecked"])
    marks = F.from_json("value", "map<string,string>")
    states = F.filter("items", lambda i: is_marked(F.element_at(marks, i)))
    listed = F.transform(states, lambda i: F.concat(F.lit("    - "), box(F.element_at(marks, i)), F.lit(" "), i))
    valued = F.transform(F.filter("items", lambda i: ~is_blank(F.element_at(marks, i))), lambda i: F.concat(F.lit("    - "), i, F.lit(": "), F.element_at(marks, i)))
    cells = lambda row: F.array_join(F.transform("items", lambda c: F.coalesce(F.nullif(F.element_at(row, c), F.lit("")), F.lit(MISSING))), " | ")
    bar = lambda inside: F.concat(F.lit("| "), inside, F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("items", lambda _: F.lit("---")), "|"), F.lit("|"))
    body = F.transform(F.from_json("value", "array<map<string,string>>"), lambda r: bar(cells(r)))
    table = F.array_join(F.concat(F.array(F.concat(F.lit("**"), F.col("label"), F.lit(":**")), bar(F.array_join("items", " | ")), rule), body), "\n")
    scored = F.from_json("value", "value string, band string")
    score = F.concat(F.when(is_blank(scored["value"]), F.lit(MISSING)).otherwise(scored["value"]), F.when(is_blank(scored["band"]), F.lit("")).otherwise(F.concat(F.lit(" ("), scored["band"], F.lit(")"))))
    kind = F.col("type")
    line = (
        F.when(kind == "checkbox", F.concat(head, F.lit(" "), box(F.col("value"))))
        .when(kind == "checklist", F.array_join(F.concat(F.array(head), listed), "\n"))
        .when(kind == "checklist_kv", F.array_join(F.concat(F.array(head), valued), "\n"))
        .when(kind == "table", table)
        .when((kind == "score") & F.col("value").startswith("{"), F.concat(head, F.lit(" "), score))
        .otherwise(F.concat(head, F.lit(" "), F.col("value")))
    )
    sections = shown.groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    body_of = F.concat(F.lit("## "), "section", F.lit("\n"), F.array_join("l.line", "\n"))
    whole = sections.select(key, F.struct(F.col("l")[0]["pos"].alias("pos"), body_of.alias("b")).alias("s")).groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return whole.select(key, F.array_join("s.b", "\n\n").alias("markdown"))


PREDICTION = (
    "array<struct<`Original Text`:string,text:string,`Predicted Code/Name`:string,`Predicted Name`:string,`Predicted Code`:string,code:string,Type:string,Confidence:string,"
    "region_id:string,region_type:string,bbox:array<double>,page:string,dataset_source:string,ocr_confidence:string,ocr_model_used:string>>"
)


def predictions(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """The region predictions in a JSON list, one row each in order; alternate keys, defaults and bad numbers are mended."""
    rows = docs.select(key, F.posexplode(F.from_json(raw, PREDICTION)).alias("reading_order", "p"))
    p = lambda name: F.col("p")[name]
    said = lambda name: F.nullif(p(name), F.lit(""))
    number = lambda name: F.coalesce(p(name).try_cast("double"), F.lit(0.0))
    return rows.select(
        key, "reading_order",
        F.coalesce(said("region_id"), F.concat(F.lit("pred_"), "reading_order")).alias("region_id"),
        F.coalesce(said("region_type"), p("Type"), F.lit("Unknown")).alias("region_type"),
        F.coalesce(p("bbox"), F.array().cast("array<double>")).alias("bbox"),
        F.coalesce(p("page").try_cast("int"), F.lit(0)).alias("page_number"),
        F.coalesce(p("Original Text"), p("text")).alias("text_content"),
        number("Confidence").alias("confidence_score"),
        p("Type").alias("entity_classification"),
        F.coalesce(said("Predicted Code/Name"), said("Predicted Name"), said("Predicted Code"), said("code")).alias("resolved_name"),
        p("dataset_source").alias("dataset_source"),
        number("Confidence").alias("resolution_confidence"),
        number("ocr_confidence").alias("ocr_confidence"),
        F.coalesce(p("ocr_model_used"), F.lit("unknown")).alias("ocr_model_used"),
    )


def patient_meta(text: Column) -> list[Column]:
    """Name, number, doctor and nurse from a header, with defaults."""
    take = lambda p, default: F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", "")), F.lit("")), F.lit(default))
    return [
        F.initcap(take(r"(?i)(?:name|patient)[:\s*_]+([A-Z][A-Z\s]+)", "Patient")).alias("name"),
        take(r"(?i)IP\s*(?:No|Number)?[:\s._]+([A-Z0-9]+)", MISSING).alias("ip_no"),
        F.initcap(take(r"(?i)(?:Treating Doctor|Consultant)[:\s*_]+([A-Z][A-Za-z\s.]+)", MISSING)).alias("doctor"),
        F.initcap(take(r"(?i)(?:Treating Nurse|Staff)[:\s*_]+([A-Z][A-Za-z\s.]+)", MISSING)).alias("nurse"),
    ]


def _blocks_below(age: Column) -> Column:
    """The blocks of 1, 2, 4, ... whole years that together cover the years from 0 to an age: one for each bit set."""
    years = F.least(F.greatest(F.floor(age), F.lit(-1)), F.lit(MOST_YEARS)).cast("long") + 1
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(YEAR_BITS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", years, k).alias("block"))), lambda b: b["block"] % 2 == 1)
    return F.transform(bits, lambda b: F.struct(b["level"].alias("level"), (b["block"] - 1).alias("block")))


def _blocks_around(age: Column) -> Column:
    """The block of each size that holds the year of an age threshold."""
    year = F.least(F.greatest(F.floor(age), F.lit(0)), F.lit(MOST_YEARS)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(YEAR_BITS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", year, k).alias("block")))


def rule_alerts(facts: DataFrame, ages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """facts (key, field, value), ages (key, age), rules (rule_id, fields, values, age_threshold, severity).

    A rule fires if one of its values is in one of its fields (in any field if it lists none), or from its age
    on. Rules are indexed by (field, value), those without fields by value alone, and ages by blocks of years: the years
    up to an age are a few such blocks, and a threshold is in one block of each size. So all joins are equalities, and
    rules may be many. Ages that are equal meet the rules once.
    """
    pairs = rules.select("rule_id", "severity", "fields", F.explode(F.array_distinct("values")).alias("value"))
    named = pairs.where(F.size("fields") > 0).select("rule_id", "severity", F.explode(F.array_distinct("fields")).alias("field"), "value")
    said = facts.select(key, "field", "value").distinct()
    met = said.join(named, ["field", "value"]).select(key, "rule_id", "severity")
    anywhere = pairs.where(F.coalesce(F.size("fields"), F.lit(0)) <= 0).select("rule_id", "severity", "value")
    met = met.unionByName(said.select(key, "value").distinct().join(anywhere, "value").select(key, "rule_id", "severity"))
    reached = ages.where("age IS NOT NULL").select("age").distinct().select("age", F.inline(_blocks_below(F.col("age"))))
    starts = rules.where("age_threshold IS NOT NULL").select("rule_id", "severity", "age_threshold", F.inline(_blocks_around(F.col("age_threshold"))))
    old = reached.join(starts, ["level", "block"]).where(F.col("age") >= F.col("age_threshold")).select("age", "rule_id", "severity")
    fired = met.unionByName(ages.select(key, "age").join(old, "age").select(key, "rule_id", "severity"))
    return fired.groupBy(key, "rule_id").agg(F.first("severity").alias("severity"))
