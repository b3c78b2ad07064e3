"""Splitting texts that are too large at natural boundaries (problem 8), by lexical cohesion.

A block of words slides over the text on either side of each place; how alike the two are, as the cosine of their
counts, is the cohesion there. Where it has a valley at a natural boundary, the topic changes; the depth of a valley is
how far cohesion falls from the peaks to its left and right. Each piece ends at the deepest valley of its window.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe

#: Words of a block, and how much a level of boundary weighs against depth, which is 0 to 2.
BLOCK, LEVEL = 48, 0.12
#: Tokens above which a piece of text without boundary inside is itself parted.
RUN = 16
#: A piece holds at least this share of the limit where a boundary allows it.
LEAST = 0.5

#: Words of three letters or more; where words aren't parted by blanks, runs of katakana and single ideographs.
_WORD = re.compile(r"([^\W\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]{3,}|[\u30a1-\u30ff]{2,}|[\u3400-\u9fff\uf900-\ufaff])")
_NATURAL = re.compile(r"[ \t]*(?:\r\n?|\n)\s*|(?<=[.!?;…])[\"')\]»”’]*[ \t]+(?=\S)|[。！？][」』）]*")


def units(machine: bpe.Transducer, text: str) -> tuple[list[str], list[int]]:
    """The text in order as parts with their sizes in tokens: cut between parts, a text encodes as the whole did.

    Long runs without a boundary, such as encoded data, are parted where a token and a character end together.
    """
    whole = machine.parts(text)
    lists = list(map(machine.pieces.__getitem__, whole))
    sizes = list(map(len, lists))
    if max(sizes, default=0) <= RUN:
        return whole, sizes
    parts, sizes = [], []
    for part, ids in zip(whole, lists):
        if len(ids) <= RUN:
            parts.append(part)
            sizes.append(len(ids))
            continue
        held, n = b"", 0
        for i in ids:
            held, n = held + machine.tokens[i], n + 1
            if n >= RUN:
                try:
                    parts.append(held.decode("utf-8"))
                except UnicodeDecodeError:
                    continue  # inside a character
                sizes.append(n)
                held, n = b"", 0
        if n:
            parts.append(held.decode("utf-8", "surrogatepass"))
            sizes.append(n)
    return parts, sizes


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Natural boundaries in characters, and their kinds: 5 before a heading, 4 a paragraph, 3 a statement at a line's end, 2 a line, 1 a sentence."""
    at, level, follows = [], [], text + " "
    for m in _NATURAL.finditer(text):
        start, end = m.span()
        gap = m[0]
        at.append(end)
        if "\n" not in gap and "\r" not in gap:
            level.append(1)
        elif follows[end] == "#":
            level.append(5)
        elif (gap.count("\n") or gap.count("\r")) > 1:
            level.append(4)
        else:
            level.append(3 if start and text[start - 1] in ";{})" else 2)
    return at, level


def cohesion(words: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each place between words, 0 to n: the cosine of the counts of the `block` words before and after it; 0 at the ends.

    Counts aren't taken anew for every place: two equal words add to the places that lie between them and have both within
    reach, and to the blocks that hold both, so it is enough to go through the pairs of equal words less than two blocks apart.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    ranked, left, right = words[order], [order[:0]], [order[:0]]
    for k in range(1, 2 * block):
        near = (ranked[:-k] == ranked[k:]) & (order[k:] - order[:-k] < 2 * block)
        if not near.any():
            break
        left.append(order[:-k][near])
        right.append(order[k:][near])
    p, q = np.concatenate(left), np.concatenate(right)
    across = np.bincount(np.maximum(p + 1, q - block + 1), minlength=n + 2) - np.bincount(np.minimum(q, p + block) + 1, minlength=n + 2)
    p, q = p[q - p < block], q[q - p < block]
    within = np.bincount(q + 1, minlength=n + block + 2) - np.bincount(p + 1 + block, minlength=n + block + 2)  # blocks by their first word, from -block on
    first = np.arange(-block, n + 1)
    norm = np.minimum(first + block, n) - np.maximum(first, 0) + 2 * np.cumsum(within)[: len(first)]
    return np.cumsum(across)[: n + 1] / np.sqrt(np.maximum(norm[: n + 1] * norm[block : block + n + 1], 1))


def depths(likeness: list[float]) -> list[float]:
    """How deep the valley at each boundary is: how far cohesion rises from there to the next peak on either side. On a slope there is none: a boundary beside which cohesion is less has depth 0."""

    def peaks(values: list[float]) -> list[float]:
        out, before, peak = [], None, 0.0
        for v in values:
            peak = peak if before is not None and before >= v else v
            out.append(peak)
            before = v
        return out

    before, after = [*likeness[:1], *likeness[:-1]], [*likeness[1:], *likeness[-1:]]
    return [a + b - 2 * v if x >= v <= y else 0.0 for a, b, v, x, y in zip(peaks(likeness), reversed(peaks(likeness[::-1])), likeness, before, after)]


def cut(machine: bpe.Transducer, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, tokens of overlap) of each piece, in characters of the text; together they cover all of it.

    Within the parts that can end a piece, boundaries of any kind are compared if there are some, else blanks,
    else all. Of these the one with the deepest valley of cohesion is taken, a higher kind counting as depth; of
    equal ones the last.
    """
    parts, sizes = units(machine, text)
    tokens, chars = [0, *accumulate(sizes)], [0, *accumulate(map(len, parts))]
    if tokens[-1] <= limit:
        return [(0, len(text), tokens[-1], 0)]
    ends, kinds = boundaries(text)
    starts = np.array(chars)
    ends = np.searchsorted(starts, np.array(ends, np.int64), side="right") - 1  # the part a boundary stands before, or in
    level = {i: kind for i, kind in zip(ends.tolist(), kinds) if 0 < i < len(parts)}
    natural = list(level)
    low = text.lower()
    apart = _WORD.split(low if len(low) == len(text) else text)  # what is between words, a word, and so on
    words, places = np.fromiter(map(hash, apart[1::2]), np.int64, len(apart) // 2), np.cumsum(np.fromiter(map(len, apart), np.int64, len(apart)))[:-1:2]
    at = np.searchsorted(places, starts[np.array(natural, np.int64)])
    score = [d + LEVEL * kind for kind, d in zip(level.values(), depths(cohesion(words)[at].tolist()))]

    def size(a: int, b: int) -> int:
        """The tokens of parts a to b as a text of their own: blanks at its end, parted before a word, join."""
        if b - a > 1 and parts[b - 1].isspace() and parts[b - 2].isspace():
            return tokens[b - 2] - tokens[a] + machine.count(parts[b - 2] + parts[b - 1])
        return tokens[b] - tokens[a]

    out, start, fresh = [], 0, 0
    while True:
        last = bisect_right(tokens, tokens[start] + limit) - 1
        if last >= len(parts):
            out.append((chars[start], len(text), size(start, len(parts)), size(start, fresh)))
            return out
        least = max(fresh + 1, bisect_left(tokens, tokens[start] + int(limit * LEAST)))
        to = bisect_right(natural, last)
        near = range(bisect_left(natural, least), to) or range(bisect_left(natural, fresh + 1), to)
        if near:
            end = natural[max(near, key=lambda k: (score[k], k))]
        else:
            end = next((i for i in range(last, least, -1) if parts[i][0].isspace()), last)
        out.append((chars[start], chars[end], size(start, end), size(start, fresh)))
        fresh, start = end, max(start + 1, bisect_right(tokens, tokens[end] - overlap) - 1)
        back = natural[bisect_left(natural, bisect_left(tokens, tokens[end] - overlap * 3 // 2)) : bisect_right(natural, start)]
        start = back[-1] if back and back[-1] > 0 else start
        while tokens[fresh] - tokens[start] > limit // 2:
            start += 1


def split(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64, name: str = bpe.BYTE_BPE_50K, folder: str | None = None) -> DataFrame:
    """Columns `doc_id, piece_no, n_pieces, start_char, end_char, n_tokens, overlap_tokens, text` of texts of more than `limit` tokens.

    Piece numbers count from 0; characters count from 0 and the end is exclusive. Every piece but the first
    begins with the last `overlap` tokens or so of the one before; without them the pieces joined are the text.
    Null, empty and smaller texts have no pieces. Repeated rows come out as often as they come in. One narrow
    map; nothing is shuffled, and only places leave the Python worker: texts are cut where they are.
    """
    ranks = bpe.vocabulary(name, folder)

    @F.arrow_udf("array<struct<start:int,end:int,n:int,o:int>>")
    def pieces(texts: pa.Array) -> pa.Array:
        machine, out = bpe.load(ranks), []
        for scalar in texts:
            text = scalar.as_py()
            found = cut(machine, text, limit, overlap) if text and (len(text) > limit or len(text.encode("utf-8", "surrogatepass")) > limit) else []  # a token has a byte at least
            out.append([dict(zip(("start", "end", "n", "o"), p)) for p in found] if len(found) > 1 else [])
        return pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "n", "o")])))

    cuts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"), pieces.asNondeterministic()(F.col(text_col)).alias("pieces"))  # else it would run for the size and for the rows
    each = cuts.select("doc_id", "whole", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "p"))
    return each.select(
        "doc_id", "piece_no", "n_pieces", F.col("p.start").alias("start_char"), F.col("p.end").alias("end_char"), F.col("p.n").alias("n_tokens"), F.col("p.o").alias("overlap_tokens"), F.substring("whole", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("text")
    )
