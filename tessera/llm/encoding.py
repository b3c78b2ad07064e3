"""Encoding of text columns with a public byte-level tokenizer (problem 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe


def ids_of(text: Column, name: str = bpe.BYTE_BPE_50K, folder: str | None = None) -> Column:
    """The ids of a text as array<int>, by the transducer of `tessera.llm.bpe`, without special tokens.

    An empty and a null text both give an empty list; strings of special tokens are ordinary text. The
    vocabulary, at most some 50,000 entries, goes to the workers inside the function.
    """
    ranks = bpe.vocabulary(name, folder)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        machine, ends, flat = bpe.load(ranks), np.zeros(len(texts) + 1, np.int32), []
        for i, text in enumerate(texts):
            flat.append(np.array(machine.encode(text.as_py()), np.int32))
            ends[i + 1] = ends[i] + len(flat[-1])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))

    return encode(text)


def count_of(text: Column, name: str = bpe.BYTE_BPE_50K, folder: str | None = None) -> Column:
    """How many ids a text has; 0 for an empty or null text."""
    ranks = bpe.vocabulary(name, folder)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        machine = bpe.load(ranks)
        return pa.array([machine.count(text.as_py()) for text in texts], pa.int32())

    return count(text)


def text_of(ids: Column, name: str = bpe.BYTE_BPE_50K, folder: str | None = None) -> Column:
    """The text of ids, decoded piece by piece; null for null, U+FFFD where bytes form no character."""
    ranks = bpe.vocabulary(name, folder)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        machine = bpe.load(ranks)
        return pa.array([None if x is None else "".join(machine.decode(x)) for x in lists.to_pylist()], pa.string())

    return decode(ids)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tokenizer) -> DataFrame:
    """Columns `doc_id, ids` of every row; one narrow map, nothing is shuffled.

    Repeated rows come out as often as they come in; an empty table gives an empty one.
    """
    return documents.select(F.col(id_col).alias("doc_id"), ids_of(F.col(text_col), **tokenizer).alias("ids"))
