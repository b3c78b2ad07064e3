"""Reading JSON that a model wrote: what can be recovered is, the rest is said. All inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import scrub

#: Characters of a text and items of a list that are kept; parameters of the functions below.
MOST_TEXT, MOST_ITEMS = 600, 16


def body(raw: Column) -> Column:
    """The JSON in an answer: what a fence holds, else from the first to the last brace if something stands before, else all."""
    t = F.trim(raw)
    fenced = F.regexp_extract(t, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    inner = F.when(fenced != "", fenced).otherwise(t)
    first, last = F.instr(inner, "{"), F.length(inner) - F.instr(F.reverse(inner), "}") + 1
    return F.when(~inner.startswith("{") & (first > 0) & inner.contains("}") & (last > first), F.substring(inner, first, last - first + 1)).otherwise(inner)


def parsed(raw: Column) -> Column:
    """The answer as a variant; null where it is no valid JSON."""
    return F.try_parse_json(body(raw))


def kind_of(value: Column) -> Column:
    """`object`, `array`, `string`, `number`, `boolean`; null for none."""
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")


def problem(raw: Column, v: Column) -> Column:
    """Why an answer can't be used, of which `v` is what `parsed` gave; null if it can."""
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty response").when(v.isNull(), "response is not valid JSON").when(~F.coalesce(kind_of(v) == "object", F.lit(False)), "response is not a JSON object")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def said(value: Column, fallback: str = "", most: int = MOST_TEXT) -> Column:
    """A text without runs of blanks, cut and without credentials; the fallback for anything but a text."""
    s = F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string"))
    clean = scrub(F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, most))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def items(value: Column, most: int = MOST_ITEMS) -> Column:
    """The first items of a list; none for anything else."""
    return F.slice(F.coalesce(F.when(kind_of(value) == "array", F.try_variant_get(value, "$", "array<variant>")), F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")), 1, most)


def texts(value: Column, most: int = MOST_ITEMS) -> Column:
    """The texts among the first items of a list, blank ones left out."""
    return F.filter(F.transform(items(value, most), lambda x: said(x)), lambda x: x != "")


def one_of(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    s = F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string"))
    return F.when(s.isin(*allowed), s).otherwise(F.lit(fallback))


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
