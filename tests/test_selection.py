import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.operators import selection as op
from tessera.plans.selection import result_of


def one_after_another(pairs, n):
    used, out = set(), []
    for turn, site in sorted({(t, s) for s, t, _, _ in pairs}):
        mine = sorted((r, i) for s, _, i, r in pairs if s == site)
        free = [i for _, i in mine if i not in used][:n]
        used |= set(free)
        out += [(site, i, k) for k, i in enumerate(free, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 3), (3, 2)])
def test_exclusive_as_by_turns(spark, seed, n):
    rng = random.Random(seed)
    pairs = [(f"s{s}", s, f"i{i}", k) for s in range(9) for k, i in enumerate(rng.sample(range(14), rng.randrange(1, 9)))]
    df = spark.createDataFrame([*pairs, *pairs[:5], ("s1", 1, None, 3)], "site string, turn int, item string, rank int")
    assert sorted(map(tuple, op.exclusive(df, n).collect())) == one_after_another(pairs, n)
    assert op.exclusive(df.where("false"), n).count() == 0


def test_paths_written_by_hand(spark):
    known = spark.createDataFrame([("src/a.ts",), ("lib/a.ts",), ("src/b/c.ts",), (None,)], "file string")
    raw = ["src/a.ts", "`./src/a.ts:12`", "a.ts", "c.ts (lines 3-9)", "repo\\src\\b\\c.ts", "nothing.ts", "", None]
    got = {r.raw: r.file for r in op.match_files(spark.createDataFrame([(x,) for x in raw], "raw string"), known).collect()}
    assert got == {"src/a.ts": "src/a.ts", "`./src/a.ts:12`": "src/a.ts", "a.ts": None, "c.ts (lines 3-9)": "src/b/c.ts", "repo\\src\\b\\c.ts": "src/b/c.ts", "nothing.ts": None, "": None, None: None}


def test_search_scores(spark):
    symbols = spark.createDataFrame([("Store.load",), ("load",), ("LOAD",), ("plain",), ("readAll",), (None,)], "symbol string")
    files = spark.createDataFrame([("src/store.ts",), ("store.ts",), ("lib/readAll.ts",)], "file string")
    asked = spark.createDataFrame([("`load` please",), ("see store.ts",), ("plain word",), ("readAll",), ("nothing",), (None,)], "request string")
    got = {}
    for r in op.search(asked, symbols, files, 9).orderBy("rank").collect():
        got.setdefault(r.request, []).append((r.id, r.score))
    assert got == {
        "`load` please": [("symbol:Store.load", 7), ("symbol:load", 7), ("symbol:LOAD", 4)],
        "see store.ts": [("file:store.ts", 10), ("file:src/store.ts", 8), ("outline:src/store.ts", 3), ("outline:store.ts", 3)],
        "plain word": [("symbol:plain", 5)],
        "readAll": [("symbol:readAll", 7), ("outline:lib/readAll.ts", 3)],
    }


def search_one_by_one(asked, symbols, files, k):
    out = []
    for q in asked:
        best, called = {}, re.findall(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", q)
        add = lambda id_, score: best.update({id_: max(score, best.get(id_, 0))})  # noqa: E731, B023
        for t in (re.sub(r"^\.?/", "", x) for x in re.findall(r"[\w@./-]+\.[A-Za-z]{1,5}\b", q)):
            for f in files:
                if f.endswith(t):
                    add(f"file:{f}", 10 if f == t else 8)
        for w in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", q):
            strong = bool(re.search(r"[a-z][A-Z]|_|[0-9]", w)) or w in called
            if strong or w[0].isupper() or len(w) >= 5:
                for s in symbols:
                    last = s.split(".")[-1]
                    if w in (s, last):
                        add(f"symbol:{s}", 7 if strong else 5)
                    elif w.lower() == last.lower():
                        add(f"symbol:{s}", 4 if strong else 2)
                for f in files:
                    if re.sub(r"\.[^.]+$", "", f.split("/")[-1]) == w:
                        add(f"outline:{f}", 3)
        out += [(q, n, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 2), (3, 3), (4, 7)])
def test_search_where_keys_share_ids(spark, seed, k):
    rng = random.Random(seed)
    words = ["index", "store", "Index", "loadAll", "LOADALL", "loadall", "run_2", "ab"]
    files = ["/".join([*rng.choices(["src", "lib", "index", "a"], k=rng.randrange(3)), rng.choice(words) + rng.choice([".ts", ".py", ".d.ts", ""])]) for _ in range(60)]
    symbols = [".".join(rng.choices([*words, "Runner"], k=rng.randrange(1, 4))) for _ in range(60)]
    asked = [" ".join(rng.choices([*words, "loadAll()", "store()", "index.ts", "./src/index.ts", "x.py", "./.ts", *files[:9], *symbols[:9]], k=rng.randrange(1, 6))) for _ in range(80)]
    one = lambda rows, name: spark.createDataFrame([(x,) for x in [*rows, None]], f"{name} string")
    got = op.search(one(asked, "request"), one(symbols, "symbol"), one(files, "file"), k).collect()
    assert sorted(map(tuple, got)) == search_one_by_one(sorted(set(asked)), sorted(set(symbols)), sorted(set(files)), k)


def test_search_of_a_name_many_share(spark):
    """Requests that all say a name which all files and symbols have: the joins give rows in proportion to the requests, not to requests times files."""
    n, k = 400, 3
    asked = spark.range(n).select(F.format_string("request %s: Load of index.ts, index", "id").alias("request"))
    symbols, files = (spark.range(n).select(F.format_string(x, "id").alias(c)) for x, c in (("Store%s.load", "symbol"), ("d%03d/index.ts", "file")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it ran is then one tree
    try:
        df = op.search(asked, symbols, files, k)
        got = df.collect()
        nodes, made = [df._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted({(r["rank"], r.id, r.score) for r in got}) == [(1, "file:d000/index.ts", 8), (2, "file:d001/index.ts", 8), (3, "file:d002/index.ts", 8)] and len(got) == n * k
    assert made and sum(made) <= 4 * k * n


def test_search_moves_only_ends_that_are_asked_for(spark, monkeypatch):
    """Paths have an end for each character: those that no request says aren't sorted and moved. With more file tokens than are broadcast, results are the same."""
    n = 300
    files = spark.range(n).select(F.format_string("packages/of/a/long/path/part%03d/index%s.ts", "id", F.col("id") % 7).alias("file"))
    asked = spark.createDataFrame([("see part003/index3.ts",), ("see index5.ts",), ("see 012/index5.ts",), ("see ./packages/of/a/long/path/part001/index1.ts",), ("see .ts",)], "request string")
    symbols = spark.createDataFrame([("Store.load",)], "symbol string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it ran is then one tree
    try:
        df = op.search(asked, symbols, files, 2)
        got, nodes, moved = sorted(map(tuple, df.collect())), [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange":
                moved += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    names = [f"packages/of/a/long/path/part{i:03}/index{i % 7}.ts" for i in range(n)]
    assert got == search_one_by_one(sorted(r.request for r in asked.collect()), ["Store.load"], names, 2)
    assert 0 < moved <= 8 * n
    monkeypatch.setattr(op, "FEW", 0)
    assert sorted(map(tuple, op.search(asked, symbols, files, 2).collect())) == got


def test_answers_of_models(spark):
    raw = ['{"a": " x  y "}', '```json\n{"a": 1}\n```', 'Sure:\n{"a": ["p", 2, " q "]}\nBye', "{broken", "[1]", '"text"', "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", "raw", answers.parsed(F.col("raw")).alias("v"))
    a = answers.at(F.col("v"), "$.a")
    rows = df.select("i", answers.problem(F.col("raw"), F.col("v")).alias("e"), answers.said(a, "-").alias("s"), answers.texts(a).alias("t")).orderBy("i").collect()
    assert [r.e for r in rows] == [None, None, None, "response is not valid JSON", "response is not a JSON object", "response is not a JSON object", "empty response", "empty response"]
    assert rows[0].s == "x y" and rows[1].s == "-" and rows[2].t == ["p", "q"] and rows[3].t == []


def test_results_by_what_comes_first(spark):
    ids = lambda *x: spark.createDataFrame([(i, "why") for i in x], "id int, reason string")
    rows = spark.createDataFrame([(i, i == 4) for i in range(1, 6)], "id int, p boolean")
    got = {r.id: (r.result, r.reason) for r in result_of(rows, ids(1), ids(1, 2), ids(2, 3), F.col("p")).collect()}
    assert got == {1: ("changed", "why"), 2: ("reverted", "why"), 3: ("skipped", "why"), 4: ("preview", None), 5: ("left", None)}
