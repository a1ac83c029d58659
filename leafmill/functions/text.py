"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
DASHES = "–—−‑"
BLANKS = ("", "null", "none", "n/a", "na", "—")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, also where `then` uses it inside a loop over an array."""
    return F.transform(F.array(value), then)[0]


def normalize_code(c: Column) -> Column:
    """Trimmed, dashes unified, blanks collapsed, lower case."""
    return F.lower(F.regexp_replace(F.translate(F.trim(c), DASHES, "-" * len(DASHES)), r"\s+", " "))


def compact_code(c: Column) -> Column:
    """The normalised code without blanks and dashes."""
    return F.regexp_replace(normalize_code(c), r"[\s-]+", "")


def is_blank(c: Column) -> Column:
    """Null, or one of the spellings of nothing."""
    return c.isNull() | F.lower(F.trim(c)).isin(*BLANKS)


def clean_output(raw: Column) -> Column:
    """What a model meant to say: inside text marks, without thoughts and fences; never empty if fences allow."""
    fences = r"(?m)^```[A-Za-z]*\s*$|```"
    opened = F.when(F.instr(raw, "<|text|>") > 0, F.substring_index(raw, "<|text|>", -1)).otherwise(raw)
    inner = F.substring_index(opened, "</|text|>", 1)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<think>.*?</think>", ""), fences, ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.trim(F.regexp_replace(raw, fences, "")))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|.*?\|>", "")


def json_payload(c: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def string_list(c: Column, most: int) -> Column:
    """The first strings of a JSON list, inside fences or not; null if it is none."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^\s*```[A-Za-z]*\s*$|```", ""))
    return F.slice(F.filter(F.from_json(bare, "array<string>"), lambda x: x.isNotNull()), 1, most)


def strip_bullet(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[-*•]+\s*", ""), r"^\d+[.)]\s*", ""))


def annotation(code: Column, kind: Column, name: Column, meaning: Column, timing: Column) -> Column:
    """[code → text], the text depending on the kind of catalog entry; [code] for unknown kinds."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    said = F.when(kind == "FREQUENCY", F.concat(empty(meaning), F.lit(" "), empty(timing))).when(kind.isin("ITEM", "SERVICE"), empty(name))
    return F.when(said.isNull(), F.concat(F.lit("["), code, F.lit("]"))).otherwise(F.concat(F.lit("["), code, F.lit(" → "), said, F.lit("]")))


def fuse_confidence(layout: Column, semantic: Column) -> Column:
    """Clamped to 0..1; a weak semantic score weighs more."""
    a, b = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (layout, semantic))
    return F.when(b < 0.3, 0.2 * a + 0.8 * b).otherwise(0.4 * a + 0.6 * b)


def parse_date(c: Column) -> Column:
    """Day, month or year; null if none parses."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")])


def map_upsert(m: Column, key: Column, value: Column) -> Column:
    rest = F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(key, value))


def media_type(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "application/pdf").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").otherwise("application/octet-stream")


def byte_size(n: Column) -> Column:
    """B, KB without decimals, MB with one."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.round(n / 1024, 0).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.round(n / 1048576, 1).cast("decimal(20,1)").cast("string"), F.lit(" MB")))
    )


def region_type(name: Column) -> Column:
    """Class names to region types by ordered substring tests (fixed values)."""
    tests = [
        ("table", "Table"), ("figure", "Figure"), ("image", "Figure"), ("title", "Title"), ("header", "Header"),
        ("footer", "Footer"), ("list", "List"), ("formula", "Formula"), ("caption", "Caption"),
    ]
    out, low = F.lit("Paragraph"), F.lower(name)
    for part, kind in reversed(tests):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def first_valid(columns: Sequence[str], least: int = 5) -> tuple[Column, Column]:
    """The first of several outputs with at least `least` characters, and the name of its column."""
    ok = [(F.length(F.trim(c)) >= least, c) for c in columns]
    return F.coalesce(*[F.when(test, F.col(c)) for test, c in ok]), F.coalesce(*[F.when(test, F.lit(c)) for test, c in ok])


#: What tokens of headers and forms start with.
NOT_ENTITIES = (
    "name", "patient name", "age", "sex", "gender", "address", "date", "time", "dob", "dr.", "dr ", "doctor", "ph:", "phone:", "email",
    "mobile", "mr.", "mrs.", "ms.", "patient:", "referred by", "hospital",
)


def entity_candidate(c: Column, known: Column) -> Column:
    """May a token be a catalog entry? Known codes are; form labels, dates, clocks, counts and doses are not."""
    t = F.trim(c)
    low = F.lower(t)
    letters = F.length(F.regexp_replace(t, r"[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(t, r"[^A-Z]", ""))
    out = F.when(known, True).when(F.length(t) < 2, False)
    out = out.when(F.exists(F.array(*map(F.lit, NOT_ENTITIES)), lambda p: F.startswith(low, p)), False)
    for shape in (r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"(?i)^\d{1,2}\s*(am|pm)$", r"^\d{1,2}:\d{2}", r"(?i)^\d+\s+[a-z]+$"):
        out = out.when(t.rlike(shape), False)
    dose = t.rlike(r"(?i)^\d+([./]\d+)?[a-z]{0,3}$") & ~t.rlike(r"[A-Z]{2,}")
    out = out.when(dose, False).when(t.rlike(r"\d"), True)
    return out.otherwise((upper >= 0.8 * F.greatest(letters, F.lit(1))) & F.length(t).between(2, 12))
