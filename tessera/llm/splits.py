"""Splits that keep related projects together (problem 1): components, then weighted rendezvous hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.common import BLANKS, checkpoint, is_filler, iso_ts, key_or_null, latest, norm_key
from tessera.llm.components import components, stars

#: Steps of a split's weight that are tried, as powers of two, and how often at most the best of them is taken.
STEPS, ROUNDS = [k / 12 for k in range(-18, 19)], 6


def repository(source: Column) -> Column:
    """host/owner/name of an address, however it is written and wherever inside the repository it leads; null if it names none."""
    s = F.lower(F.btrim(source, F.lit(BLANKS)))
    s = F.regexp_replace(s, r"^git\+", "")
    s = F.regexp_replace(s, r"^[a-z][a-z0-9+.-]*:/+", "")
    s = F.regexp_replace(s, r"[?#].*$", "")
    s = F.regexp_replace(s, r"^[^/@]*@", "")
    s = F.regexp_replace(s, r"^([^/:]+):\d+(?=/)", "$1")
    s = F.regexp_replace(s, r"^([^/:]+):/*", "$1/")
    s = F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), r"/{2,}", "/")
    s = F.regexp_extract(s, r"^([^/\s]+\.[^/\s]+/[^/\s]+/[^/\s]+)", 1)
    return F.nullif(F.regexp_replace(s, r"(\.git)+$", ""), F.lit(""))


def projects(records: DataFrame) -> DataFrame:
    """Columns `slug, fingerprint, repo, split` of the current row of each project; the three are null where they say nothing."""
    held = latest(records, key_or_null("slug"), iso_ts("updated"), ["fingerprint", "source", "split"])
    mark = norm_key("fingerprint")
    return held.select(F.col("key").alias("slug"), F.when(~is_filler(mark), mark).alias("fingerprint"), F.when(~is_filler(norm_key("source")), repository(F.col("source"))).alias("repo"), key_or_null("split").alias("split"))


def groups(projects: DataFrame) -> DataFrame:
    """Columns `slug, component` of every project: what shares a fingerprint or a repository, directly or through others, shares the component.

    Projects that share with none are components of their own.
    """
    keyed = projects.select(F.col("slug").alias("node"), F.explode(F.array(F.concat(F.lit("f:"), "fingerprint"), F.concat(F.lit("r:"), "repo"))).alias("key"))
    joined = components(stars(keyed)).select(F.col("node").alias("slug"), "component")
    return projects.select("slug").join(joined, "slug", "left").withColumn("component", F.coalesce("component", "slug"))


def pairs(groups: DataFrame) -> DataFrame:
    """Columns `slug_a, slug_b` (slug_a < slug_b) of projects in one component."""
    a, b = (groups.select(F.col("slug").alias(f"slug_{x}"), "component") for x in "ab")
    return a.join(b, "component").where("slug_a < slug_b").select("slug_a", "slug_b")


def draws(component: Column, names: list[str], seed: str) -> dict[str, Column]:
    """-ln of what each split draws for a component: a number by the hash of seed, component and split's name, above 0 and below 1."""
    out = {}
    for name in names:
        digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), component, F.lit("\0"), F.lit(name)), 256)
        out[name] = -F.log((F.conv(F.substring(digest, 1, 14), 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / float(1 << 56))
    return out


def weights_for(by_component: DataFrame, ratios: dict[str, float]) -> dict[str, float]:
    """Weights under which the shares of entries come near the ratios.

    `by_component` has `weight` and the draw of each split, `draw_<name>`. Shares drawn by the ratios themselves stray from
    them by chance, far if a component is large; so the weights are varied, and those kept under which
    the shares are nearest. A pass over the components gives the shares under all weights that are tried.
    """
    names, best = sorted(ratios), dict(ratios)
    for _ in range(ROUNDS):
        tried = [best, *(best | {name: best[name] * 2**step} for name in names for step in STEPS if step)]
        shares = F.array(*[F.array(*[F.lit(math.log(w[n])) for n in names]) for w in tried])
        score = lambda w: F.array_min(F.array(*[F.struct(F.log(f"draw_{n}") - w[i], F.lit(i).alias("split")) for i, n in enumerate(names)]))["split"]
        sums = by_component.select("weight", F.posexplode(F.transform(shares, score)).alias("trial", "split")).groupBy("trial", "split").agg(F.sum("weight").alias("n")).collect()  # trials x splits
        total = sum(r["n"] for r in sums if r["trial"] == 0)
        if not total:
            return best
        got = {(r["trial"], names[r["split"]]): r["n"] / total for r in sums}
        off = [sum((got.get((t, n), 0.0) - ratios[n]) ** 2 for n in names) for t in range(len(tried))]
        t = min(range(len(tried)), key=lambda k: (round(off[k], 9), k))
        if t == 0:
            return best
        best = tried[t]
    return best


def assign(groups: DataFrame, sizes: DataFrame, ratios: dict[str, float], seed: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Columns `slug, component, entries, split`: components go whole into splits, shares of entries come near the ratios.

    Weighted rendezvous hashing: each split draws a number for a component, and the one with the least -ln(draw) / weight
    wins; the draws of a component depend on no other. With fixed `weights` neither does its split, and who gives those
    of an earlier run keeps its splits; without, `weights_for` finds weights, and a component moves only where they change
    between two runs, from splits that grew to those that shrank. `sizes` has `slug, entries`; projects without entries
    count as 0. Ties of draws can't be; a split with ratio 0 gets nothing.
    """
    ratios = {name: share for name, share in sorted(ratios.items()) if share > 0}
    sized = groups.select("slug", "component").join(sizes.select("slug", "entries"), "slug", "left").withColumn("entries", F.coalesce("entries", F.lit(0)).cast("long"))
    drawn = checkpoint(sized.groupBy("component").agg(F.sum("entries").alias("weight")).select("component", "weight", *[d.alias(f"draw_{n}") for n, d in draws(F.col("component"), list(ratios), seed).items()]))
    weights = weights or weights_for(drawn, ratios)
    score = F.array_min(F.array(*[F.struct((F.col(f"draw_{n}") / F.lit(weights[n])).alias("score"), F.lit(n).alias("split")) for n in ratios]))
    return sized.join(drawn.select("component", score["split"].alias("split")), "component").select("slug", "component", "entries", "split")
