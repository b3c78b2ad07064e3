import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, encoding

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no vocabularies here")


@pytest.fixture(scope="module")
def machine():
    return bpe.load(bpe.vocabulary())


@pytest.fixture(scope="module")
def other(machine):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=machine.ranks, special_tokens={})


def same(machine, other, text):
    ids = machine.encode(text)
    assert ids == other.encode_ordinary(text)
    assert machine.count(text) == len(ids)
    assert "".join(machine.decode(ids)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(machine, other, text):
    same(machine, other, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefgh =-_\t\n\r\x0b\x1c\x1f\x85  '.0", max_size=300))
def test_blanks_and_control_characters(machine, other, text):
    same(machine, other, text)


def test_long_runs(machine, other):
    rng = random.Random(3)
    for piece in ("a", "=", "-", " ", "\n", "é", "日", "👍", "ab", "0", "xy12", "é́"):
        for n in (1, 2, 63, 64, 65, 127, 128, 129, 5000):
            same(machine, other, piece * n)
            same(machine, other, piece * n + rng.choice("az \n"))


def test_special_tokens_are_text(machine, other):
    same(machine, other, "x<|endoftext|>y")


def test_state_is_short_and_lookups_are_bounded(machine, monkeypatch):
    monkeypatch.setattr(bpe, "MOVES", 500)
    small = bpe.Transducer(machine.ranks)
    text = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(20000))
    assert list(small.stream(text.encode())) == list(machine.stream(text.encode()))
    assert len(small.states) < 1500 and max(map(len, small.states)) <= 2 * small.lookahead


def test_another_vocabulary(other):
    tiktoken = pytest.importorskip("tiktoken")
    multi = bpe.Transducer(bpe.vocabulary("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("multi", pat_str=bpe.SPLIT, mergeable_ranks=multi.ranks, special_tokens={})
    for text in ("Überprüfung der Rückgabe", "返金を記録する。しきい値", "naïve façade", "a" * 300):
        assert multi.encode(text) == theirs.encode_ordinary(text)


def test_table(spark, machine):
    rows = [(1, "hello world", 5), (2, "", 6), (3, None, 7), (3, None, 7), (4, "é" * 60000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode(df).collect()}
    assert got[2] == got[3] == [] and got[1] == machine.encode("hello world") and got[4] == machine.encode("é" * 60000)
    assert encoding.encode(df).count() == 5
    assert encoding.encode(df.where("false")).count() == 0
    back = df.select("text", encoding.text_of(encoding.ids_of(F.col("text"))).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
