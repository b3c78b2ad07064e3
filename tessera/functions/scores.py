"""Scores, verdicts and policies as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("none", "low", "medium", "high")

# For each feature the level that judged code shows most, and the level that exact code shows most.
PROFILE = {
    "semantic_ambiguity": ("high", "none"),
    "context_dependence": ("high", "low"),
    "deterministic_expressibility": ("low", "high"),
    "judgment_required": ("high", "none"),
    "rule_stability": ("low", "high"),
    "risk_or_policy_component": ("high", "low"),
    "natural_language_understanding": ("high", "none"),
    "decision_complexity": ("medium", "low"),
}


def rank(level: Column) -> Column:
    """0 to 3; null for an unknown level."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)) - 1


def feature_match(level: Column, feature: str) -> Column:
    """1 if a level is nearer to judged code, 0 if nearer to exact code, 0.5 between; null if not reported."""
    near, far = (F.abs(rank(level) - LEVELS.index(top)) for top in PROFILE[feature])
    return F.when(near < far, 1.0).when(near == far, 0.5).when(near > far, 0.0)


def pattern_score(levels: Column) -> Column:
    """The mean match of the reported features of a map or struct; null if none is."""
    parts = F.array(*[feature_match(levels[name], name) for name in PROFILE])
    known = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def semantic_score(bounded: Column, judgment: Column, exact_is_right: Column) -> Column:
    """A bounded answer is a precondition; need of judgment counts 0.6, that exact code is wrong 0.4."""
    return bounded * (0.6 * judgment + 0.4 * (1 - exact_is_right))


def blend(a: Column, b: Column) -> Column:
    """The mean of two scores, or the one there is."""
    return F.coalesce((a + b) / 2, a, b)


def average(*scores: Column) -> Column:
    """The mean of the scores there are; null if there are none."""
    n = sum((s.isNotNull().cast("int") for s in scores[1:]), scores[0].isNotNull().cast("int"))
    return F.when(n > 0, sum((F.coalesce(s, F.lit(0.0)) for s in scores[1:]), F.coalesce(scores[0], F.lit(0.0))) / n)


def verdict(*scores: Column) -> Column:
    """REVIEW_DISAGREE if scores stand on both sides of a half, else by their mean; WEAK_FIT without scores."""
    mean = average(*scores)
    yes = F.greatest(*[F.coalesce(s >= 0.5, F.lit(False)) for s in scores])
    no = F.greatest(*[F.coalesce(s < 0.5, F.lit(False)) for s in scores])
    return F.when(yes & no, "REVIEW_DISAGREE").when(mean >= 0.7, "STRONG_FIT").when(mean >= 0.5, "POSSIBLE_FIT").otherwise("WEAK_FIT")


def missing(**scores: Column) -> Column:
    """The names of the scores that are null."""
    return F.filter(F.array(*[F.when(s.isNull(), F.lit(name)) for name, s in scores.items()]), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Policy:
    """Thresholds of a validation."""

    semantic_min: float = 0.5
    assist_min: float = 0.8
    assist_semantic_min: float = 0.4
    reject_min: float = 0.8

    def decide(self, semantic: Column, kind_is_semantic: Column, kind_confidence: Column) -> Column:
        """confirmed or rejected; a kind that is surely not semantic rejects, one that surely is helps a little."""
        return (
            F.when(~kind_is_semantic & (kind_confidence >= self.reject_min), "rejected")
            .when(semantic >= self.semantic_min, "confirmed")
            .when(kind_is_semantic & (kind_confidence >= self.assist_min) & (semantic >= self.assist_semantic_min), "confirmed")
            .otherwise("rejected")
        )


def validated_score(status: Column, semantic: Column, least: int = 50) -> Column:
    """Hundredths of the semantic probability; a confirmed one is at least the least shown."""
    raw = F.floor(F.coalesce(semantic, F.lit(0.0)) * 100 + 0.5)
    return F.when(status == "confirmed", F.greatest(raw, F.lit(least))).otherwise(raw)
