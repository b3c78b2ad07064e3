import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, sinks
from tessera.streaming import rollups


def test_scan(spark, tmp_path):
    for name, body in {"src/a.ts": "x", "src/b.py": "é", "node_modules/c.js": "x", "src/deep/er/d.tsx": "x", "readme.md": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")
    got = {r.path: r.text for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": "x", "src/b.py": "é", "src/deep/er/d.tsx": "x"}
    assert {r.path for r in files.scan(spark, str(tmp_path), include=["src/*.ts", "deep"], exclude=["**/a.ts"]).collect()} == {"src/deep/er/d.tsx"}


def test_scan_with_gitignore(spark, tmp_path):
    for name in ("src/a.ts", "src/gen/b.ts", "gen/c.ts", "a.min.js", "src/a.min.js", "tmp/x.js", "src/tmp/y.js", "keep.min.js", "logs.ts"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("# made\n*.min.js\n/gen\n!keep.min.js\ntmp/\n\nlogs\n")
    assert {r.path for r in files.scan(spark, str(tmp_path)).collect()} == {"src/a.ts", "src/gen/b.ts", "keep.min.js", "logs.ts"}


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    bad.write_text('{"a": 1}\nnot json\n')
    assert sorted((r.a, r.b) for r in files.json_lines(spark, str(good), "a int, b string").collect()) == [(1, None), (2, "x")]
    with pytest.raises(Exception):
        files.json_lines(spark, str(bad), "a int").collect()
    rows, broken = files.json_lines_lenient(spark, str(bad), "a int")
    assert [r.a for r in rows.collect()] == [1] and [r.line for r in broken.collect()] == ["not json"]


def test_projects_cases_packages(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/project.json").write_text(json.dumps({"slug": "one", "split": "train"}, indent=2))
    (tmp_path / "one/expected.json").write_text(json.dumps({"positive": [{"file": "a", "context": "f"}], "negative": [{"file": "b", "context": "g", "note": "n"}]}))
    assert files.projects(spark, f"{tmp_path}/*/project.json", "slug string, split string").collect()[0].slug == "one"
    assert sorted((r.repo, r.positive, r.file) for r in files.cases(spark, f"{tmp_path}/*/expected.json").collect()) == [("one", False, "b"), ("one", True, "a")]
    p = spark.createDataFrame([({"next": "1", "react": "2", "left-pad": "1"}, {"react": "3"}), (None, None)], "dependencies map<string,string>, devDependencies map<string,string>")
    assert [r.frameworks for r in files.frameworks(p, ["dependencies", "devDependencies"]).collect()] == [["next", "react"], []]


def test_layered():
    assert files.layered({"words": ["a"], "weights": {"x": 1, "y": 2}, "n": 1}, {"words": ["b", "a"], "weights": {"y": 3}, "n": None}, {"n": 5}) == {"words": ["a", "b"], "weights": {"x": 1, "y": 3}, "n": 5}


def test_select_corpus(spark):
    intake = spark.createDataFrame([("a", "ready", 1), ("a", "ready", 1), ("b", "blocked", 2), ("c", "partial", 3)], "slug string, status string, ordinal int")
    assert sorted(r.slug for r in files.select_corpus(intake, []).collect()) == ["a", "c"]
    assert [r.slug for r in files.select_corpus(intake, ["3", "b"]).collect()] == ["c"]


def test_gated_write(spark, tmp_path):
    path = str(tmp_path / "entries")
    rows = spark.createDataFrame([("b", 2), ("a", None)], "id string, n int")
    none = spark.createDataFrame([], "problem string")
    sinks.gated(rows, none, path, ["id"])
    with pytest.raises(sinks.Refused) as e:
        sinks.gated(rows.limit(1), spark.createDataFrame([("bad",), ("bad",)], "problem string"), path, ["id"])
    assert e.value.problems == {"bad": 2}
    lines = [x.value for x in spark.read.text(sinks.gated_path(spark, path)).collect()]
    assert sorted(lines) == ['{"id":"a"}', '{"id":"b","n":2}']
    sinks.gated(rows.where("id = 'b'"), none, path, ["id"])
    assert spark.read.text(sinks.gated_path(spark, path)).count() == 1


def test_insert_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "too long"), (3, None)], "id int, s string")
    for _ in range(2):
        sinks.insert_checked(rows, {"long": F.length("s") > 3, "odd": F.col("id") == 2}, str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t/inserted")).collect()) == [1, 1, 3, 3]
    assert [(r.id, r.problems) for r in spark.read.parquet(str(tmp_path / "t/rejected")).collect()] == [(2, ["long", "odd"])] * 2


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.last(spark, root) is None
    sinks.snapshot(spark.range(1), root)
    second = sinks.snapshot(spark.range(2), root)
    assert sinks.last(spark, root) == second and sinks.read_last(spark, root).count() == 2
    sinks.undo(spark, root)
    assert sinks.read_last(spark, root).count() == 1
    assert sinks.undo(spark, root) is None and sinks.last(spark, root) is None and sinks.undo(spark, root) is None
    third = sinks.snapshot(spark.range(3), root)
    assert sinks.last(spark, root) == third and sinks.undo(spark, root) is None
    old = {"usages": spark.createDataFrame([("p", "s1", 1), ("p", "s2", 1)], "project string, site string, v int"), "runs": spark.createDataFrame([(1,)], "r int")}
    new = {"usages": spark.createDataFrame([("p", "s2", 2)], "project string, site string, v int"), "runs": spark.createDataFrame([(2,)], "r int")}
    sinks.save_run({}, {"runs": old["runs"]}, {}, str(tmp_path / "run"))
    sinks.save_run(old, new, {"usages": ["project", "site"]}, str(tmp_path / "run"))
    assert sorted(map(tuple, sinks.read_last(spark, str(tmp_path / "run/usages")).collect())) == [("p", "s1", 1), ("p", "s2", 2)]
    assert spark.read.parquet(str(tmp_path / "run/runs")).count() == 2


def test_markdown(spark):
    out = sinks.markdown(spark.createDataFrame([("a|b", 1), (None, 2)], "x string, y int").orderBy("y"), "T", most=1)
    assert "| a\\|b | 1 |" in out and "Cut to 1 rows." in out


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rollups.windowed(stream, "ts", "40 days", "1 day", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("daily").collect()} == want
    q = rollups.first_of(stream, "ts", "40 days", "user_id").writeStream.outputMode("append").format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("first_seen").count() == events.select("user_id").distinct().count()
