import itertools
import os
import random

import numpy as np
import pytest

from tessera.llm import bpe, packing, pieces


def test_repeated_rows_have_containers_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    rows = [("x", 250)] * 4 + [("y", 100)] * 3 + [(f"i{i}", 30) for i in range(20)]
    got = packing.pack(spark.createDataFrame(rows, "id string, n int"), "id", "n", 100).collect()
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(n for _, n in rows)
    assert len(fill) == 8 + 3 + 2 + 7 and sorted(fill) == list(range(len(fill)))  # 50s by twos, 30s by threes


def test_best_fill_is_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        fill = packing.best_fill(counts, room)
        assert all(0 < n <= counts[s] for s, n in fill.items())
        sizes = [s for s, n in counts.items() for _ in range(n)]
        best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
        assert sum(s * n for s, n in fill.items()) == best


def least_containers(counts, c):
    """A lower bound: items above half a container stand alone, and those that no item of at least k can join leave their room unused."""
    best = 0
    for k in range(c // 2 + 1):
        over = sum(n for s, n in counts.items() if s > c - k)
        half = [(s, n) for s, n in counts.items() if c - k >= s > c / 2]
        rest = sum(s * n for s, n in counts.items() if c / 2 >= s >= k)
        room = sum((c - s) * n for s, n in half)
        best = max(best, over + sum(n for _, n in half) + max(0, -(-(rest - room) // c)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_item(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(60)}
    left = dict(counts)
    n = 0
    for times, fill in packing.patterns(counts, 100):
        assert sum(s * k for s, k in fill.items()) <= 100
        n += times
        for s, k in fill.items():
            left[s] -= k * times
    assert not any(left.values())
    assert least_containers(counts, 100) <= n <= 1.03 * least_containers(counts, 100)


@pytest.mark.parametrize("hot", [False, True])
def test_pack(spark, hot):
    rng = random.Random(7)
    rows = [(i, 40 if hot and i % 3 == 0 else rng.choice([0, 1, 7, 33, 50, 99, 100, 101, 250, 300]), "x") for i in range(900)] + [(1000, None, "x"), (1001, -5, "x"), (5, 33, "x"), (5, 33, "x")]
    df = spark.createDataFrame(rows, "id long, size int, container string")
    got = packing.pack(df, "id", "size", 100).collect()
    fill = {}
    for r in got:
        fill.setdefault(r.container, []).append((r.place, r["size"]))
    assert all(sum(s for _, s in items) <= 100 and sorted(p for p, _ in items) == list(range(len(items))) for items in fill.values())
    whole = {}
    for r in got:
        whole.setdefault(r.id, []).append((r.start, r["size"]))
    for i, n, _ in rows:
        if (n or 0) <= 0:
            assert i not in whole or i in (5,)
    for i, parts in whole.items():
        want = sorted(n for j, n, _ in rows if j == i and (n or 0) > 0)
        assert sum(s for _, s in parts) == sum(want)
        if len(want) == 1:
            assert len(parts) == (1 if want[0] <= 100 else -(-want[0] // 100))
            at = 0
            for start, s in sorted(parts):
                assert start == at
                at += s
    rests, full = {}, 0
    for _, n, _ in rows:
        if (n or 0) > 0:
            full += n // 100
            if n % 100:
                rests[n % 100] = rests.get(n % 100, 0) + 1
    assert len(fill) == full + sum(times for times, _ in packing.patterns(rests, 100))


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "id long, size int"), "id", "size", 10).count() == 0


@pytest.fixture(scope="module")
def machine():
    if not os.path.isdir(bpe.TOKENIZERS):
        pytest.skip("no vocabularies here")
    return bpe.load(bpe.vocabulary())


TEXTS = {
    "prose": "The sample is plain. It repeats! Does it end?  " * 120,
    "code": "function a(x) {\n  return x.map((y) => y + 1);\n}\n\n" * 90,
    "headings": "".join(f"# Part {i}\n\nSome words about {w} and {w}.\n\n" * 6 for i, w in enumerate(["apples", "rivers", "engines", "poems", "taxes"])) * 3,
    "run": "=" * 60000,  # 938 tokens
    "letters": "".join(random.Random(1).choice("abcdefghij") for _ in range(9000)),
    "japanese": "記録を却下する人がいない。しきい値は返金を知らせる。" * 120,
    "minified": '{"a":1,"b":[2,3],"c":"d"},' * 400,
    "mixed": ("x" * 700 + "\r\n\r\n  tail\t\n") * 40,
    "emoji": "👍🏽é́" * 900,
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(512, 64), (64, 8), (100, 0)])
def test_cut(machine, name, limit, overlap):
    text = TEXTS[name]
    end, found = 0, pieces.cut(machine, text, limit, overlap)
    assert len(found) > 1
    for k, (a, b, n, o) in enumerate(found):
        assert machine.count(text[a:b]) == n <= limit
        assert a <= end < b
        if k:
            assert machine.count(text[a:end]) == o
            assert o <= max(2 * overlap, overlap + 40)
        end = b
    assert end == len(text)


def test_cuts_at_boundaries(machine):
    for a, b, _, _ in pieces.cut(machine, TEXTS["headings"], 512, 64)[:-1]:
        assert TEXTS["headings"][:b].endswith("\n")


def test_cut_finds_the_change_of_topic(machine):
    one, two = "The river floods the valley and the river bank. " * 22, "Engines burn petrol and engines need oil. " * 40
    first = pieces.cut(machine, one + two, 400, 32)[0]
    assert abs(first[1] - len(one)) <= 50


def test_split_table(spark, machine):
    rows = [(1, TEXTS["prose"], 3), (1, TEXTS["prose"], 3), (2, "short", 1), (3, "", 1), (4, None, 1), (5, "   " * 2000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_no int")
    got = pieces.split(df).collect()
    assert {r.doc_id for r in got} <= {1, 5}
    one = sorted((r.piece_no, r.start_char, r.end_char, r.text) for r in got if r.doc_id == 1)
    assert one[::2] == one[1::2] and all(t == TEXTS["prose"][a:b] for _, a, b, t in one)
    assert pieces.split(df.where("false")).count() == 0


def test_cohesion_as_by_counts():
    from collections import Counter

    rng = random.Random(3)
    for n, kinds, block in ((0, 1, 4), (1, 1, 4), (7, 2, 4), (60, 5, 8), (200, 30, 48), (150, 1, 8)):
        words = np.array([rng.randrange(kinds) for _ in range(n)], np.int64)
        got = pieces.cohesion(words, block)
        for i in range(n + 1):
            left, right = Counter(words[max(0, i - block) : i].tolist()), Counter(words[i : i + block].tolist())
            norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
            assert got[i] == pytest.approx(sum(left[w] * right[w] for w in left) / norm if norm else 0)


def test_depth_needs_a_rise_on_a_side():
    assert pieces.depths([0.9, 0.5, 0.2, 0.6, 0.8, 0.7]) == pytest.approx([0, 0, 1.3, 0, 0, 0.1])
    assert pieces.depths([]) == [] and pieces.depths([0.3]) == [0]
    assert pieces.depths([0.9, 0.7, 0.5, 0.3])[:3] == [0, 0, 0]  # a slope isn't a valley
