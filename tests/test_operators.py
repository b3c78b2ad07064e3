import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import facts as fx
from tessera.functions import paths, generic, scores, text
from tessera.operators import adaptive, datasets, evidence, folds, graph, intervals, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Scores: hand-worked figures.


@pytest.mark.parametrize(
    "three,mean,verdict",
    [
        ((0.9, 0.7, 0.6), 0.733333, "STRONG_FIT"),
        ((0.6, 0.55, None), 0.575, "POSSIBLE_FIT"),
        ((0.9, 0.4, 0.1), 0.466667, "REVIEW_DISAGREE"),
        ((0.1, None, 0.3), 0.2, "WEAK_FIT"),
        ((None, None, None), None, "WEAK_FIT"),
    ],
)
def test_verdicts(spark, three, mean, verdict):
    row = spark.createDataFrame([three], "a double, b double, c double").select(F.round(scores.average(*map(F.col, "abc")), 6).alias("mean"), scores.verdict(*map(F.col, "abc")).alias("verdict")).first()
    assert (row.mean, row.verdict) == (mean, verdict)


def test_pattern_score(spark):
    df = spark.createDataFrame([({"semantic_ambiguity": "high", "rule_stability": "medium", "decision_complexity": "unknown"},), ({},), ({"judgment_required": "none", "context_dependence": "medium"},)], "f map<string,string>")
    assert [r.s for r in df.select(F.round(scores.pattern_score(F.col("f")), 6).alias("s")).collect()] == [0.75, None, 0.25]


def test_blend_and_semantic(spark):
    f = lambda x: F.lit(x).cast("double")
    assert round(one(spark, scores.blend(f(0.5), f(0.9))), 9) == 0.7
    assert one(spark, scores.blend(f(0.5), f(None))) == 0.5 and one(spark, scores.blend(f(None), f(None))) is None
    assert round(one(spark, scores.semantic_score(f(0.5), f(1.0), f(0.0))), 9) == 0.5


def test_policy(spark):
    p = scores.Policy()
    decide = lambda s, k, c: one(spark, p.decide(F.lit(s), F.lit(k), F.lit(c)))
    assert decide(0.9, False, 0.9) == "rejected" and decide(0.9, False, 0.5) == "confirmed"
    assert decide(0.45, True, 0.85) == "confirmed" and decide(0.35, True, 0.95) == "rejected" and decide(0.45, True, 0.5) == "rejected"
    assert one(spark, scores.validated_score(F.lit("confirmed"), F.lit(0.42))) == 50 and one(spark, scores.validated_score(F.lit("rejected"), F.lit(0.42))) == 42


# Evaluation: eight rows worked out by hand.


def test_metrics(spark):
    L = "struct<label:string>"
    rows = [
        (1, "active", "generated", ("STRONG",), ("STRONG", "model"), False),
        (2, "active", "generated", ("NOT",), ("POSSIBLE", "model"), False),
        (3, "active", "generated", ("POSSIBLE",), ("NOT", "triage"), False),
        (4, "active", "generated", ("NOT",), ("NOT", "triage"), False),
        (5, "active", "generated", ("STRONG",), ("NOT", "model"), None),
        (6, "active", "generated", ("STRONG",), (None, "none"), False),
        (7, "active", "missed", ("POSSIBLE",), (None, "none"), False),
        (8, "active", "generated", ("STRONG",), ("STRONG", "model"), True),
        (9, "stale", "generated", ("STRONG",), ("STRONG", "model"), False),
        (10, "active", "generated", None, ("STRONG", "model"), False),
    ]
    df = spark.createDataFrame(rows, f"id int, status string, origin string, human {L}, auto struct<label:string,source:string>, needsRecheck boolean")
    m = metrics.rates(metrics.judged(df).agg(*metrics.counts())).first()
    assert (m.entries, m.needs_recheck, m.labelled, m.predicted, m.unclassified) == (9, 1, 7, 5, 1)
    assert (m.tp, m.fp, m.fn, m.tn, m.filtered, m.agreed, m.overturned) == (1, 1, 2, 1, 2, 1, 1)
    assert (m.precision, m.recall, m.proposed_positives, m.missed_positives) == (0.5, 0.333333, 4, 1)
    none = metrics.rates(metrics.judged(df.where("false")).agg(*metrics.counts())).first()
    assert none.precision is None and none.entries == 0


def test_evidence_levels(spark):
    case = lambda p, c, b: one(spark, evidence.confidence(F.lit(p), F.lit(c), F.lit(b)))
    assert [case(3, False, True), case(3, True, True), case(2, False, True), case(2, True, True), case(1, False, True), case(9, False, False)] == ["high", "medium", "medium", "low", "low", "low"]
    assert [one(spark, evidence.strength(F.lit(r), F.lit(p))) for r, p in ((5, 2), (2, 1), (1, 1))] == ["cross_project", "recurring_in_one_project", "single_example"]


# Datasets.

OLD = "id string, code_hash string, status string, origin string, human string, human_hash string, created string, updated string"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", "active", "generated", "YES", "1", "c", "u"), ("b", "1", "active", "generated", "NO", "1", "c", "u"), ("c", "1", "active", "generated", None, None, "c", "u"), ("d", "1", "stale", "generated", None, None, "c", "u"), ("e", "1", "active", "missed", "YES", "1", "c", "u")], OLD)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("f", "1")], "id string, code_hash string")
    got = {r.id: r for r in datasets.upsert(old, new, "id", F.lit("now")).collect()}
    assert {k: r.action for k, r in got.items()} == {"a": "updated", "b": "updated", "c": "became_stale", "d": "stale", "e": "kept", "f": "added"}
    assert (got["a"].needs_recheck, got["b"].needs_recheck, got["b"].human, got["f"].created, got["d"].updated, got["c"].updated) == (False, True, "NO", "now", "u", "now")
    assert datasets.upsert(old.where("false"), new.where("false"), "id", F.lit("now")).count() == 0


def test_fresh_hits(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    cache = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "1"), ("b", "z", "9"), ("c", "gone", "1")], "k string, item string, hash string")
    items = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "item string, hash string")
    assert {r.k: r.hit for r in datasets.fresh_hits(wanted, cache, items, "k").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_split_shares(spark):
    x = spark.range(2000).select(datasets.unit_hash(F.lit("seed"), F.sha2(F.col("id").cast("string"), 256)).alias("x"))
    n = {r.s: r["count"] for r in x.select(datasets.assign_split(F.col("x"), F.lit(0.6), F.lit(0.2)).alias("s")).groupBy("s").count().collect()}
    assert 0.55 < n["train"] / 2000 < 0.65 and n["test"] / 2000 > 0.16


# Folds, intervals, graphs against plain loops.


def test_folds(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(4)}", i, rng.randrange(1, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, size int")
    taken = {r.i: (r.taken, r.used) for r in folds.budget_with_skip(df, ["k"], [F.desc("size"), F.col("i")], "i", "size", 200, "k string, i int, taken boolean, used long").collect()}
    part = {r.i: r.part for r in folds.next_fit(df, ["k"], [F.col("i")], "i", "size", 50, "k string, i int, part int").collect()}
    even = {r.i: r.part for r in folds.smallest_first(df.withColumn("n", F.lit(3)), ["k"], [F.desc("size"), F.col("i")], "i", "size", "n", "k string, i int, part int").collect()}
    for k in {r[0] for r in rows}:
        mine, used = [r for r in rows if r[0] == k], 0
        for _, i, s in sorted(mine, key=lambda r: (-r[2], r[1])):
            fits = used + s <= 200
            used += s if fits else 0
            assert taken[i] == (fits, used)
        at = used = 0
        for _, i, s in sorted(mine, key=lambda r: r[1]):
            if used and used + s > 50:
                at, used = at + 1, 0
            used += s
            assert part[i] == at
        sums = [sum(s for _, i, s in mine if even[i] == p) for p in range(3)]
        assert max(sums) - min(sums) <= 30
    empty = df.where("false")
    assert folds.next_fit(empty, ["k"], [F.col("i")], "i", "size", 50, "k string, i int, part int").count() == 0


def test_intervals(spark):
    rng = random.Random(5)
    iv = [("f", rng.randrange(0, 900), rng.randrange(1, 300), f"n{i}") for i in range(60)]
    iv = [(f, s, s + n, name) for f, s, n, name in iv] + [("f", None, 5, "null"), ("f", 9, 3, "backward")]
    pts = [("f", f"p{i}", rng.randrange(0, 1300)) for i in range(80)]
    got = {(r.point): (r.start, r.end, r.name) for r in intervals.innermost(spark.createDataFrame(pts, "file string, point string, line int"), spark.createDataFrame(iv, "file string, start int, end int, name string"), ["file"], "point").collect()}
    for _, p, line in pts:
        held = [(s, -e, n) for _, s, e, n in iv if s is not None and s <= line <= e]
        assert got.get(p) == ((max(held)[0], -max(held)[1], max(held)[2]) if held else None)
    left = spark.createDataFrame([(f, n, s, e) for f, s, e, n in iv[:30]], "file string, a string, start int, end int")
    right = spark.createDataFrame([(f, n, s, e) for f, s, e, n in iv[30:60]], "file string, b string, start int, end int")
    pairs = {(r.left_id, r.right_id) for r in intervals.overlapping(left, right, ["file"], "a", "b").collect()}
    assert pairs == {(a[3], b[3]) for a in iv[:30] for b in iv[30:60] if a[1] <= b[2] and b[1] <= a[2]}
    kept = [r for r in folds.no_overlap(spark.createDataFrame([(f, n, s, e) for f, s, e, n in iv[:60]], "file string, id string, start int, end int"), ["file"], [F.col("id")], "id", "file string, id string, kept boolean").collect()]
    by, out = {n: (s, e) for _, s, e, n in iv}, []
    for n in sorted(n for _, _, _, n in iv[:60]):
        free = all(by[n][1] < by[m][0] or by[m][1] < by[n][0] for m in out)
        assert next(r.kept for r in kept if r.id == n) == free
        out += [n] if free else []


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "x"), ("x", "y"), ("e", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.level for r in graph.reach(edges, start, 3).collect()} == {"a": 0, "b": 1, "c": 2, "x": 2, "d": 3, "y": 3}
    assert {r.node for r in graph.reach(edges, start, 4, spark.createDataFrame([("b",)], "node string")).collect()} == {"a", "b"}


# Text.


def test_text_functions(spark):
    s = lambda f, v: one(spark, f(F.lit(v)))
    assert s(text.name_tokens, "getHTTPUser_name-x2") == ["get", "http", "user", "name", "x2"]
    assert [s(text.is_word_like, v) for v in ("refund", "money back", "can't", "graph TD", "camelCase", "kebab-case", "SOME_CODE", "json", "x")] == [True, True, True, False, False, False, False, False, False]
    assert s(text.is_multi_word, "two words") and not s(text.is_multi_word, "one")
    assert s(text.slugify, "Error Message / Regex Classifier!") == "error-message-regex-classifier" and s(text.slugify, "!!") is None
    assert s(text.pattern_words, "refund|money back") == ["refund", "money back"] and s(text.pattern_words, r"(\d+) items") == []
    assert [s(text.band_for, v) for v in (95, 80, 60, 10)] == ["strong", "likely", "possible", "ignore"]
    assert s(text.numbered, "a\nb") == "   1| a\n   2| b"
    assert s(lambda c: text.snippet(c, 2, 3), "abcdef\nxy\nz") == "abc…\nxy"
    assert s(text.content_hash, " a\t b\n") == s(text.content_hash, "a b")
    assert s(text.looks_generated, "x" * 2001) and not s(text.looks_generated, "x\n" * 100) and one(spark, text.looks_generated(F.lit(None).cast("string"))) is None


def test_paths(spark):
    s = lambda f, v: one(spark, f(F.lit(v)))
    assert [s(paths.read_priority, p) for p in ("app/api/refund/route.ts", "app/components/CustomCursor.tsx", "app/checkout/page.tsx", "src/components/List.tsx", "readme.md")] == [0, 3, 1, 2, 0]
    assert [s(paths.file_role, p) for p in ("a.d.ts", "x/tests/a.ts", "a.stories.tsx", "generated/a.ts", "vite.config.ts", "scripts/a.ts", "src/a.ts")] == ["types", "test", "story", "generated", "config", "script", "source"]
    assert s(paths.path_kind, "app/api/x.ts") == "api" and s(paths.path_kind, "x.ts") == "other"


def test_generic_text(spark):
    code = """import { Queue } from "./queue";
// secretName in a comment
const maxOpen = "too many open tickets"; /* otherName */
function loadUser(error) { return new Error(`user ${maxOpen} gone`); }"""
    df = spark.createDataFrame([("src/billing/userStore.ts", "Store.loadUser", code), (None, None, None)], "f string, u string, c string")
    names = [r.n for r in df.select(generic.names_in(F.col("f"), F.col("u"), F.col("c")).alias("n")).collect()]
    assert names == [["too many open tickets", "userStore.ts", "user   gone", "userStore", "loadUser", "./queue", "billing", "maxOpen", "Queue", "Store"], []]
    texts = [("loadUser reads src/lib/user.ts and https://a.b/c", ["loadUser"]), ("Store. Queue loadUser failed in a.tsx", ["loadUser", "Queue", "Store"]), ("reloadUser  a\\E|b \n c", ["a\\E|b", "loadUser"]), ("", []), (None, ["x"]), ("key sk_live_abcdefghijklmnop1234", [])]
    got = [r.g for r in spark.createDataFrame(texts, "t string, n array<string>").select(generic.generic_text(F.col("t"), F.col("n"), 60).alias("g")).collect()]
    assert got == ["<name> reads <path> and <url>", "<name> failed in <file>", "reloadUser <name> c", None, None, "key [REDACTED]"]


CODE = """function rankTicket(ticket, limit) {
  const data = await fetchData(ticket);
  if (!ticket) return null;
  if (/refund|urgent/i.test(ticket.text)) return "high";
  if (data.includes("spam")) { return "low"; }
  switch (ticket.kind) {
    case "bug": return "middle";
    case "idea": return "low";
    case "praise": return "none";
  }
  if (limit > 3) score += 2;
  return "none";
}"""


def test_facts(spark):
    f = fx.facts(CODE)
    assert [c["shapes"] for c in f["conditions"]] == [["trivial"], ["regex"], ["text_method"], ["relational"]]
    assert [c["operands"][0]["provenance"] for c in f["conditions"]] == ["parameter", "parameter", "awaited_call", "parameter"]
    assert [(a["line"], a["discriminant"], a["values"]) for a in f["arms"]] == [(6, "ticket.kind", ["bug", "idea", "praise"])]
    assert f["params"] == ["ticket", "limit"] and f["awaits"] == 1 and f["accumulations"] == 1 and f["calls"] == ["rankTicket", "fetchData", "test", "includes"]
    row = spark.createDataFrame([(CODE,), ("",), (None,)], "c string").select(fx.facts_of(F.col("c")).alias("f")).select(fx.generators(F.col("f")).alias("g"), fx.outcomes(F.col("f")).alias("o"), fx.features(F.col("f"))["conditions"].alias("n")).collect()
    assert set(row[0].g) >= {"outcome-set", "branch-map", "gate", "text-match"} and "high" in row[0].o and row[0].n == 4
    assert not row[1].g and not row[2].g


# Planted units: what each is, and why it is no decision after all.
UNITS = [
    ("(a, b) => { return a.rank - b.rank; }", "sorting_filtering"),
    ("function f(x) { if (!x) return; if (x === null) return; run(x); }", "trivial_guard"),
    ("async function f() { try { await g(); } catch (err) { if (err.message.includes('timeout')) return 1; if (/reset/.test(err.code)) return 2; } }", "library_error_text"),
    ("function f() { if (process.env.MODE === 'on') { return 'a'; } if (process.env.KIND === 'x') { return 'b'; } return 'c'; }", "feature_flag"),
    ("function f(k: 'a' | 'b' | 'c') { switch (k) { case 'a': return 'one'; case 'b': return 'two'; case 'c': return 'three'; } }", "enum_dispatch"),
    ("function f(c) { if (c === '(') return 1; if (c === ')') return 2; if (c === ',') return 3; }", "parsing"),
    ("function f(name) { if (name === '.png') return 'image'; if (name === 'text/html') return 'page'; }", "file_type"),
    ("function f(res) { if (res.status === 404) return 'gone'; if (res.status >= 500) return 'down'; }", "protocol_status"),
    ("function onKey(e) { if (e.key === 'Enter now') return send(); if (e.code === 'Escape it') return close(); }", "ui_plumbing"),
    ("function area(w, h) { return w * h + 2 * w; }", "arithmetic"),
    ("function View(p) { if (isReady(p)) return <div>{p.name}</div>; return <span/>; }", "ui_plumbing"),
    ("function f(x) { if (check(x)) { go(x); } }", "trivial_guard"),
    ("function f(text) { if (text.includes('refund please')) return 'money'; if (/angry|upset/.test(text)) return 'care'; return 'other'; }", None),
]


def test_triage_of_planted_units(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(UNITS)], "i int, c string").select("i", fx.facts_of(F.col("c")).alias("f"))
    rows = df.select("i", fx.triage(F.col("f"), fx.generators(F.col("f"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [t for _, t in UNITS]


PY = """def route(item, limit=3):
    \"\"\"It's a doc with 'quotes' (and brackets\"\"\"
    total = 0
    if item.kind == "open" and len(item.lines) > 1:
        total += 2
    elif "urgent" in item.text.lower():
        return "fast"
    return "slow" if total > limit else "later"
"""


def test_facts_of_python():
    f = fx.facts(PY)
    assert [(c["line"], c["shapes"], [(o["name"], o["provenance"]) for o in c["operands"]]) for c in f["conditions"]] == [
        (4, ["exact_literal", "trivial"], [("item.kind", "parameter"), ("item.lines", "parameter")]),
        (6, ["membership"], [("item.text", "parameter")]),
        (8, ["relational"], [("total", "constant")]),
    ]
    assert [r["value"] for r in f["returns"]] == ["fast", "slow", "later"] and f["params"] == ["item", "limit"] and f["accumulations"] == 1 and f["ternaries"] == 1


def test_facts_of_odd_texts():
    assert fx.facts(None) is None and fx.facts(" \n") is None
    for odd in ("(((", "if", "return", "))) }", "case 'a':", "switch (", "x ? y", "`${", "''" + "'", "if (a", "a" * 100_000, "if (x) {" * 500):
        assert fx.facts(odd)["lines"] == 1


def test_guard_chains(spark):
    from tessera.plans.extraction import exiting_runs

    exits = {"a": [1, 1, 0, 1, 1, 1], "b": [1, 0, 1], "c": []}
    rows = [(k, n, 10 + n, bool(x)) for k, xs in exits.items() for n, x in enumerate(xs)]
    got = exiting_runs(spark.createDataFrame(rows, "id string, n int, line int, exits boolean")).collect()
    assert sorted((r.id, r.start, r.end, r.length) for r in got) == [("a", 10, 11, 2), ("a", 13, 15, 3)]


def test_suggestions(spark):
    code = ["function f(x) { return x > 3 && ok(x); }", UNITS[-1][0], "function f(x) { let s = 0; if (x.a > 1) { s += 2; } if (x.b > 2) { s += 3; } return s * 2; }", "function f(x) { go(x); }"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(code)], "i int, c string").select("i", fx.facts_of(F.col("c")).alias("f")).withColumn("g", fx.generators(F.col("f")))
    rows = df.select("i", fx.suggestion(F.col("f"), F.col("g")).alias("p"), fx.explanation(F.lit("f"), F.col("f"), F.col("g")).alias("e")).orderBy("i").collect()
    assert [r.p for r in rows] == ["noul", "choice", "score", "none"] and rows[1].e == "f chooses one outcome from text"


# The shell around a client.


def test_converse(spark):
    def client(prompt, n):
        if "broken" in prompt:
            raise RuntimeError("no")
        return {"answer": f"{len(prompt)}", "more": "more" if "long" in prompt else None, "tokens": 60}

    rows = spark.createDataFrame([(1, "short"), (2, "long"), (3, "broken"), (4, None)], "id int, p string")
    got = {r.key: r for r in adaptive.converse(rows, "id", "p", client, rounds=5, budget=150).collect()}
    assert [got[i].stopped for i in (1, 2, 3, 4)] == ["answered", "budget", "error", "empty"]
    assert got[2].rounds == 3 and got[2].tokens == 180 and got[3].retries == 2 and got[3].error == "no"


def test_converse_with_requests_tiers_and_pools(spark):
    known = {"unit:a": "the unit a"}

    def first(prompt, n):
        if "flaky" in prompt:
            raise RuntimeError("busy")
        if "wants a" in prompt and "the unit a" not in prompt:
            return {"answer": None, "more": "unit:a", "tokens": 1}
        if "wants b" in prompt:
            return {"answer": "guess", "more": "unit:b", "tokens": 1}
        return {"answer": "first", "tokens": 1}

    def second(prompt, n):
        return {"answer": "second", "tokens": 2}

    rows = spark.createDataFrame([(1, "wants a"), (2, "wants b"), (3, "flaky"), (4, "plain"), (5, None)], "id int, p string").coalesce(1)
    got = {r.key: r for r in adaptive.converse(rows, "id", "p", [first, second], rounds=5, retries=1, resolve=known.get, workers=4).collect()}
    assert [(got[i].answer, got[i].rounds, got[i].stopped) for i in range(1, 6)] == [("first", 2, "answered"), ("guess", 2, "unresolved"), ("second", 1, "answered"), ("first", 1, "answered"), (None, 0, "empty")]
    assert got[3].retries == 1 and got[3].tokens == 2


def test_converse_stops_after_a_fatal_failure(spark):
    def client(prompt, n):
        if prompt == "bad":
            raise PermissionError("no such key")
        return {"answer": prompt, "tokens": 1}

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None)], "id int, p string").coalesce(1)
    got = {r.key: (r.stopped, r.retries) for r in adaptive.converse(rows, "id", "p", client, fatal=lambda e: isinstance(e, PermissionError)).collect()}
    assert got == {1: ("answered", 0), 2: ("error", 0), 3: ("skipped", 0), 4: ("empty", 0)}


def test_loose_find(spark):
    df = spark.createDataFrame([("a\n  b = 1\nc", "b = 1"), ("a\n\tb = 1\n\tc = 2\nd", "  b = 1\n  c = 2"), ("x\nx", "x"), ("a", None)], "t string, w string")
    rows = [r.f for r in df.select(adaptive.loose_find(F.col("t"), F.col("w")).alias("f")).collect()]
    assert [(r.start, r.end, r.exact) for r in rows] == [(4, 9, True), (2, 15, False), (None, None, None), (None, None, None)]
