"""Texts without what identifies where they come from, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import scrub

# Folders that say nothing about a project, names of the language, and what makes a name specific.
COMMON = ("src", "app", "lib", "api", "components", "pages", "utils", "server", "client", "index", "main", "test", "tests")
BUILTIN = "Error|TypeError|Promise|String|Number|Boolean|Array|Object|Math|JSON|Date|Map|Set|RegExp|Record|Partial|Response|Request|URL|console|process|window|document"
SPECIFIC = r"[a-z][A-Z]|^[A-Z][a-z0-9]+[A-Z]|_|\d|^[A-Z][A-Z0-9_]{2,}$|\."

# What becomes a mark. Classes and ends are spelled out so that all engines read them alike.
ADDRESS, PATH = r"https?://[^ \t\r\n\f]+", r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"
FILE = r"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_-]*\.(?:[cm]?[jt]sx?|json|css|html|md)(?![A-Za-z0-9_])"

_COMMENTS, _LITERAL = r"(?s)/\*.*?\*/|(?<=^|[^:\\])//[^\n]*", r"""(?s)(["'`])((?:\\.|(?!\1)[^\\])*?)\1"""


def names_in(file: Column, unit: Column, code: Column) -> Column:
    """Names that identify where code comes from, longest first: folders and file, words of the unit's name, specific identifiers outside comments and literals, and literals that are specific or of several words. Nulls have none."""
    none = F.array().cast("array<string>")
    specific = lambda w: w.rlike(SPECIFIC)
    parts = F.coalesce(F.split(file, r"[\\/]"), none)
    base = lambda p: F.regexp_replace(p, r"\.[^.]+$", "")
    folders = F.flatten(F.transform(F.filter(parts, lambda p: ~F.lower(base(p)).isin(*COMMON)), lambda p: F.array(p, base(p))))
    body = F.regexp_replace(F.coalesce(code, F.lit("")), _COMMENTS, " ")
    identifiers = F.filter(F.regexp_extract_all(F.regexp_replace(body, _LITERAL, " "), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)), lambda w: specific(w) | w.rlike("^[A-Z][a-z]{2,}$"))
    literals = F.transform(F.regexp_extract_all(body, F.lit(_LITERAL), F.lit(2)), lambda x: F.trim(F.regexp_replace(x, r"\$\{[^}]*\}", " ")))
    whole = F.filter(literals, lambda x: (F.length(x) >= 4) & (x.rlike(r"\s\S+\s*\S") | specific(x) | x.rlike("[@#/:]")))
    words = F.filter(F.flatten(F.transform(literals, lambda x: F.split(x, r"[^\w$@.-]+"))), lambda w: (F.length(w) >= 4) & specific(w))
    found = F.transform(F.concat(folders, F.coalesce(F.split(unit, r"[^\w$]+"), none), identifiers, whole, words), F.trim)
    kept = F.array_distinct(F.filter(found, lambda n: (F.length(n) >= 3) & ~n.rlike(f"^(?:{BUILTIN})$")))
    return F.transform(F.array_sort(F.transform(kept, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: x["n"])


def generic_text(text: Column, names: Column, most: int) -> Column:
    """A text with addresses, paths, files and the given names replaced, without credentials, on one line and cut to a length; null for a null or empty text.

    Names are taken as they are, the first of those that fit, so they should come longest first.
    """
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ADDRESS, "<url>"), PATH, "<path>"), FILE, "<file>")
    quoted = F.transform(names, lambda n: F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?<![\w$])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\w$])"))
    t = F.when(F.size(names) > 0, F.regexp_replace(t, pattern, F.lit("<name>"))).otherwise(t)
    t = F.regexp_replace(t, r"(?:<name>[ \t\r\n\f.]*){2,}", "<name> ")
    return F.nullif(F.substring(scrub(F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))), 1, most), F.lit(""))
