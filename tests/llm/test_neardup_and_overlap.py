import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import grams, neardup, overlap, regions

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, k=3):
    w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def texts(rng, families=25, alone=60):
    out = []
    for _ in range(families):
        base = [rng.choice(WORDS) for _ in range(rng.choice([12, 40, 120, 300]))]
        for _ in range(rng.randrange(2, 5)):
            v = list(base)
            for _ in range(len(v) // 40):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v))
    out += [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 20, 200]))) for _ in range(alone)]
    rng.shuffle(out)
    return out


def test_words_and_sets_as_by_pattern():
    rng = random.Random(9)
    chars = "aB_9 é\n-.日İ\x00"
    many = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "a b c", "x" * 5000]
    for (_, got), text in zip(grams.gram_sets(pa.array(many)), many, strict=True):
        assert len(got) == len(shingles(text)) and (np.diff(got.astype(np.int64)) > 0).all()


def test_chunks_change_nothing(monkeypatch):
    many = pa.array(texts(random.Random(1)))
    one = [s.tobytes() for _, s in grams.gram_sets(many)]
    monkeypatch.setattr(grams, "CHUNK", 100)
    assert [s.tobytes() for _, s in grams.gram_sets(many)] == one
    assert [s.tobytes() for _, s in grams.gram_sets(many.slice(7))] == one[7:]


def classes(spark, many):
    df = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(many)], "id string, text string").withColumn("s", neardup.sets_of(F.col("text"), 3)).select("id", "s.cls", "s.grams")
    df = spark.createDataFrame(df.collect(), df.schema)
    return df.select("id", "cls"), df.where("grams is not null").select("cls", "grams").dropDuplicates(["cls"])


def found(spark, many, least=0.5):
    members, cls = classes(spark, many)
    return {(r.id_a, r.id_b) for r in neardup.expand(neardup.links(cls, least), members.where("id is not null")).collect()}


def brute(many, least=0.5):
    return {(f"{i:04d}", f"{j:04d}") for i in range(len(many)) for j in range(i + 1, len(many)) if many[i] == many[j] or similar(many[i], many[j]) >= least}


def clear(many, pairs, margin=0.08):
    """Leaves out pairs near the threshold, as the forest is sure only away from it."""
    return {p for p in pairs if abs(similar(many[int(p[0])], many[int(p[1])]) - 0.5) > margin}


@pytest.mark.parametrize("region,block", [(48, 512), (2, 3)])
def test_links_against_brute_force(spark, monkeypatch, region, block):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "BLOCK", block)
    many = texts(random.Random(3)) + ["one two", "one two", "other words"]
    got = found(spark, many)
    assert clear(many, brute(many)) <= got <= brute(many)


def test_hot_family(spark, monkeypatch):
    """A third of all rows are near copies: their regions are compared in blocks."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(150)]
    family = []
    for i in range(90):
        v = list(base)
        v[i] = f"own{i}"
        family.append(" ".join(v))
    many = family + texts(rng, 10, 100)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    got = found(spark, many)
    assert clear(many, brute(many)) <= got <= brute(many)


def test_hot_family_that_differs_much(spark):
    rng = random.Random(11)
    base = [rng.choice(WORDS) for _ in range(150)]
    many = [" ".join(rng.choice(WORDS) if rng.random() < 0.05 else w for w in base) for _ in range(120)]
    got, want = found(spark, many), brute(many)
    assert got <= want and len(got) >= 0.985 * len(want)  # as the docstring of the module has it


@pytest.mark.parametrize("hold", [10, 1 << 18])
def test_walk_parts_no_region(hold):
    key, who = np.array([0] + [1] * 60 + [2, 2, 3, 4], np.int64), np.arange(65, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in (key, who)], names=["key", "who"]) for i in range(0, 65, 7)]
    rows = [r for b in regions._meet(iter(batches), neardup._pairs, 48, hold) for r in b.to_pylist()]
    hot = {}
    for r in rows:
        if r["hot"] is not None:
            hot.setdefault(r["hot"], set()).add(r["who"])
    assert hot == {0: {0}, 1: set(range(1, 61)), 4: {64}}
    assert [(r["a"], r["b"]) for r in rows if r["a"] is not None] == [(61, 62)]


def test_families_behind_one_notice(spark, monkeypatch):
    """Many small families whose texts begin with one notice: their regions are large, and no link is lost."""
    monkeypatch.setattr(neardup, "REGION", 4)
    rng = random.Random(17)
    notice, many = [rng.choice(WORDS) for _ in range(40)], []
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(60)]
        for k in range(3):
            v = list(base)
            v[10 + k] = f"own{rng.randrange(10**6)}"
            many.append(" ".join(notice + v))
    assert found(spark, many) == brute(many)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], "cls long, grams binary")
    assert neardup.links(none, 0.5).count() == 0
    members, cls = classes(spark, ["a b c d e f", "a b c d e f", "x y z"])
    odd = cls.withColumn("key", F.lit(1)).withColumn("a", F.lit(2)).withColumn("sketch", F.lit(3))
    assert neardup.links(odd, 0.5).count() == 0
    assert neardup.expand(neardup.links(odd, 0.5), members).count() == 1


def sided(spark, many, side):
    return spark.createDataFrame([(4 * i, s, t, 0) for i, (s, t) in enumerate(zip(side, many))], "cls long, side int, code string, head int")


def linked(df, **kw):
    return {(r.a // 4, r.b // 4) for r in overlap.links(df, 0.5, **kw).collect()}


def across(many, side):
    return {(i, j) for i in range(len(many)) for j in range(len(many)) if i != j and side[i] & 1 and side[j] & 2 and similar(many[i], many[j]) >= 0.5}


@pytest.mark.parametrize("region,hold", [(48, None), (2, None), (2, 5)])
def test_overlap_against_brute_force(spark, region, hold):
    rng = random.Random(6)
    notice = " ".join(rng.choice(WORDS) for _ in range(30)) + "\n"
    many = [notice + t if rng.random() < 0.4 else t for t in texts(rng)]
    side = [rng.choice([1, 2, 3]) for _ in many]
    assert linked(sided(spark, many, side), region=region, hold=hold) == across(many, side)


def edited(rng, words):
    """Near copies by each kind of edit, down to a similarity of a half: words replaced, put in and left out, blocks moved."""
    out = list(words)
    for _ in range(rng.randrange(1, max(2, len(words) // 7))):
        kind, at = rng.randrange(4), rng.randrange(len(out))
        if kind == 0:
            out[at] = "r" + str(rng.randrange(10**6))
        elif kind == 1:
            out.insert(at, "i" + str(rng.randrange(10**6)))
        elif kind == 2 and len(out) > 4:
            del out[at]
        elif kind == 3:
            block, rest = out[at : at + len(out) // 5], out[:at] + out[at + len(out) // 5 :]
            to = rng.randrange(len(rest) + 1)
            out = rest[:to] + block + rest[to:]
    return out


def test_no_pair_is_lost_to_the_bound_on_coverage(spark):
    rng = random.Random(21)
    many, side = [], []
    for n in (5, 8, 12, 18, 25, 30, 45, 60, 90, 140, 200) * 12:
        base = [rng.choice(WORDS) for _ in range(n)]
        many += [" ".join(base), " ".join(edited(rng, base))]
        side += rng.sample([1, 2], 2)
    want = across(many, side)
    assert len(want) > 60 and linked(sided(spark, many, side)) == want


def test_overlap_hot_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(120)]
    many = []
    for i in range(60):
        v = list(base)
        v[2 * i] = f"own{i}"
        many.append(" ".join(v))
    assert linked(sided(spark, many, [1 + i % 2 for i in range(60)]), region=4, hold=16) == {(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2)}


@pytest.mark.parametrize("hold", [24, 1 << 18])
def test_a_head_of_all_texts_loses_none(spark, hold):
    """One head in 400 texts, let go in parts: all of its suffixes come out, though parts have one side only."""
    many = [f"a b c d e f own{i}" for i in range(400)]
    found = overlap.shared(sided(spark, many, [1 if i < 390 else 2 for i in range(400)]), places=True, hold=hold).collect()
    assert sorted(r.who >> 2 for r in found) == list(range(400)) and {r.info for r in found} == {0}


def test_overlap_of_nothing(spark):
    none = spark.createDataFrame([], "cls long, side int, code string")
    assert overlap.links(none, 0.5).count() == 0 and overlap.coverage(none).count() == 0
    assert linked(sided(spark, ["", "a b", None], [1, 2, 2])) == set()


def test_overlap_of_repeated_lines(spark):
    """Texts of many words and few distinct runs."""
    many = []
    for i in range(40):
        line = [f"w{i}x{j}" for j in range(7)]
        many += [" ".join(line * 60), " ".join(line * 30 + ["other"] + line * 29)]
    assert linked(sided(spark, many, [1, 2] * 40)) == {(i, i + 1) for i in range(0, 80, 2)}


def words_covered(text, train, k=6):
    w = re.findall("[a-z0-9_]+", text.lower())
    return len({j for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in train for j in range(i, i + k)})


def test_coverage_against_brute_force(spark):
    rng = random.Random(12)
    long = [rng.choice(WORDS) for _ in range(600)]
    many, side = [" ".join(long)], [1]
    for n in (5, 6, 8, 12, 40, 600):  # a span of n words in a text of its own
        many.append(" ".join([f"x{n}y{i}" for i in range(100)] + long[150 : 150 + n] + [f"z{n}y{i}" for i in range(100)]))
        side.append(2)
    many += [*texts(rng, 10, 10), "p q r s t u p q r s t u", " ".join(["a b c d e f"] * 40)]
    side += [rng.choice([1, 2, 3]) for _ in many[len(side) :]]
    got = {r.cls // 4: r.covered for r in overlap.coverage(sided(spark, many, side)).collect()}
    train = {tuple(w[i : i + 6]) for s, t in zip(side, many) if s & 1 for w in [t.lower().split()] for i in range(len(w) - 5)}
    want = {i: words_covered(t, train) for i, (s, t) in enumerate(zip(side, many)) if s & 2}
    assert got == {i: n for i, n in want.items() if n} and [want[i] for i in range(1, 6)] == [0, 6, 8, 12, 40]


def test_sequences_tell_order_and_repeats(spark):
    many = ["a b c a b c", "A b-c a b c", "a b c a b c a b c", "b c a b c a", "", None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in many], "t string").select(overlap.sequence_of(F.col("t")).alias("s")).collect()]
    assert got[0] == got[1] and got[4] == got[5] and len(set(got)) == 4


def test_coverage_has_every_held_out_entry(spark, sf):
    from tessera.llm import queries

    rows = queries.p3_coverage(spark, sf).collect()
    assert len(rows) == sum(r.entries for r in queries.p3_report(spark, sf).collect())
