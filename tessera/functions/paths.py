"""What a path says about its file: role, kind, language, reading order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered patterns; the first that matches decides.
ROLES = (
    (r"\.d\.[cm]?ts$", "types"),
    (r"\.(test|spec)\.[cm]?[jt]sx?$|(^|/)(__tests__|__mocks__|test|tests|e2e|cypress)/", "test"),
    (r"\.stories\.[cm]?[jt]sx?$", "story"),
    (r"(^|/)(generated|__generated__|\.next|\.nuxt|\.svelte-kit|out|coverage)/|\.gen(erated)?\.[cm]?[jt]sx?$", "generated"),
    (r"\.config\.[cm]?[jt]s$|(^|/)\.?[A-Za-z0-9_-]+rc\.[cm]?[jt]s$", "config"),
    (r"(^|/)(scripts|bin)/", "script"),
)
KINDS = (
    (r"(^|/)api/", "api"),
    (r"(^|/)(lib|utils?|helpers?|core|domain)/", "lib"),
    (r"(^|/)(server|services?|handlers?|workers?|jobs?|actions?)/", "server"),
    (r"(^|/)components/", "component"),
    (r"(^|/)(app|pages)/", "page"),
)
LANGUAGES = ((r"\.[cm]?tsx?$", "typescript"), (r"\.[cm]?jsx?$", "javascript"), (r"\.py$", "python"), (r"\.ya?ml$", "yaml"))
PRIORITIES = (
    (r"(^|/)(api|server|services?|lib|utils?|helpers?|core|domain|actions?|handlers?|routes?|workers?|jobs?|models?)/|(route|handler|service|controller)\.[cm]?[jt]sx?$", 0),
    (r"(^|/)(landing|sections|marketing|icons|animations?)/|(cursor|globe|hero|footer|header|navbar|avatar|logo|icon|button)[A-Za-z0-9_]*\.[jt]sx$", 3),
    (r"(^|/)components/", 2),
    (r"\.[jt]sx$", 1),
)
NOT_READ = r"\.(test|spec|stories)\.[cm]?[jt]sx?$|\.d\.ts$|(^|/)(__tests__|__mocks__|__snapshots__|tests?|e2e|migrations|generated|__generated__|vendor)/|(^|/)components/ui/|(^|/)[^/]*\.config\.[cm]?[jt]s$|(^|/)next-env\.d\.ts$"
LOGIC = r"(^|/)(api|lib|server|services?|core|agents?|routes?|handlers?|controllers?|domain|utils?|engine|bot|workers?|jobs?|llm|ai|pipeline|src)/"
DECIDES = r"(classif|categor|moderat|filter|spam|detect|intent|route|router|triage|rank|scor|priorit|label|sentiment|tone|toxic|policy|guard|valid|review|match|recommend|prompt|llm|agent|judge|decid|select|pick|tag)"
SURFACE = r"(^|/)(components?|ui|views?|pages?|styles?|app/\(.*\))/"


def first_match(col: Column, rules: tuple, default) -> Column:
    """The value of the first rule whose pattern is found; null for a null path."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(col.rlike(pattern), F.lit(value)).otherwise(out)
    return F.when(col.isNotNull(), out)


def file_role(path: Column) -> Column:
    return first_match(path, ROLES, "source")


def path_kind(path: Column) -> Column:
    return first_match(path, KINDS, "other")


def language_of(path: Column) -> Column:
    return first_match(F.lower(path), LANGUAGES, "other")


def read_priority(path: Column) -> Column:
    """0 is read first; logic by place or name goes before everything else, so its rule stands first."""
    return first_match(F.lower(path), PRIORITIES, 0)


def not_read(path: Column) -> Column:
    return path.rlike(NOT_READ)


def prior(path: Column) -> Column:
    """How likely a file holds decisions: +2 by folder, +3 by name, -1 for surfaces, -0.5 for markup files."""
    low = F.lower(path)
    flag = lambda c: c.cast("double")
    return 2 * flag(low.rlike(LOGIC)) + 3 * flag(F.element_at(F.split(low, "/"), -1).rlike(DECIDES)) - flag(low.rlike(SURFACE)) - 0.5 * flag(path.rlike(r"\.(tsx|jsx)$"))
