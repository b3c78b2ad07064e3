"""Byte-pair encoding as a streaming transducer with bounded lookahead.

Encodings have two properties that make a transducer of the merge list: every run of tokens of an
encoding is the encoding of its own bytes, and a sequence of tokens is an encoding exactly if each two
neighbours are. So the encodings of all beginnings of a text form a tree: each position points to where
the last token of the beginning that ends there starts. A token still open at the end of what was read
starts at a position from which the bytes read so far begin some token, and no token is longer than
the longest of the vocabulary; these few positions are the lookahead. What all of their paths share can't
change any more, whatever follows, and is emitted; only the bytes after it are kept. These kept bytes are
the state of the machine; its transitions are worked out when first met and then looked up.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import regex

#: Fixed value: the pattern by which the public byte-level vocabularies part a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What SPLIT comes to on texts of ASCII alone, where a plainer engine is faster.
SPLIT_ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"

#: Where the vocabularies lie unless a caller says otherwise.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Entries a lookup table may hold before it starts anew, so that memory doesn't grow with the text.
PIECES, MOVES = 1 << 18, 1 << 18
#: Characters from which a text is parted piece by piece instead of at once.
LONG = 1 << 20


def vocabulary(name: str = BYTE_BPE_50K, folder: str | None = None) -> bytes:
    """The rank file of a public byte-level tokenizer."""
    with open(os.path.join(folder or TOKENIZERS, name), "rb") as f:
        return f.read()


class _Pieces(dict):
    """From a piece of text to its ids; pieces not seen yet run through the machine."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.machine.ids(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 48:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class _State(dict):
    """The bytes not yet certain, how long the token is that ends at each of them, and where tokens begin that may go on. As a dict: from the next byte to the next state and the ids that became certain; moves not seen yet are worked out."""

    __slots__ = ("kept", "last", "machine", "open", "rest")

    def __init__(self, machine: Transducer, kept: bytes, last: tuple[int, ...], open: tuple[int, ...]):
        super().__init__()
        self.machine, self.kept, self.last, self.open, self.rest = machine, kept, last, open, None

    def __missing__(self, byte: int) -> tuple[_State, tuple[int, ...]]:
        machine = self.machine
        machine.known += 1
        if machine.known >= MOVES:
            machine._forget()
        move = self[byte] = machine.move(self, byte)
        return move


class Transducer:
    """Encoder and decoder of one merge list; see the module's text."""

    def __init__(self, ranks: bytes | dict[bytes, int]):
        if isinstance(ranks, bytes):
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sorted = sorted(ranks)
        #: The longest token; an open token starts less than this many bytes before the end of what was read.
        self.lookahead = max(map(len, ranks), default=1)
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)
        self._forget()
        self.pieces = _Pieces(self)

    def _forget(self) -> None:
        self.states: dict[bytes, _State] = {b"": _State(self, b"", (), ())}
        self.start, self.known, self.agreed = self.states[b""], 0, {}

    def merged(self, text: bytes) -> list[bytes]:
        """The encoding of a few bytes by the merge list itself: the earliest merge first, then from the left."""
        rank, none = self.ranks.get, 1 << 60
        parts = [text[i : i + 1] for i in range(len(text))]
        merges = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
        while merges and (first := min(merges)) < none:
            i = merges.index(first)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del merges[i]
            if i:
                merges[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(merges):
                merges[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def agree(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens may be neighbours in an encoding."""
        known = self.agreed.get((left, right))
        if known is None:
            if len(self.agreed) >= MOVES:
                self.agreed.clear()
            known = self.agreed[left, right] = self.merged(left + right) == [left, right]
        return known

    def opens(self, text: bytes) -> bool:
        """Whether some token begins with these bytes and goes on."""
        i = bisect.bisect_right(self.sorted, text)
        return i < len(self.sorted) and self.sorted[i].startswith(text)

    def move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The state after one more byte, and the ids that became certain."""
        text = state.kept + bytes((byte,))
        n, last, size = len(text), state.last, 1
        began = (*state.open, n - 1)  # what ends or goes on here was open before, or begins here
        for at in began:
            if text[at:] in self.ranks and (at == 0 or self.agree(text[at - last[at - 1] : at], text[at:])):
                size = n - at
                break
        last = (*last, size)
        goes_on = [at for at in began if self.opens(text[at:])]
        ends = {n, *goes_on}
        while len(ends) > 1:  # back to where the paths of all of them meet
            far = max(ends)
            ends.remove(far)
            ends.add(far - last[far - 1])
        cut = ends.pop()
        out, i = [], cut
        while i > 0:
            out.append(self.ranks[text[i - last[i - 1] : i]])
            i -= last[i - 1]
        kept = text[cut:]
        to = self.states.get(kept)
        if to is None:
            to = self.states[kept] = _State(self, kept, last[cut:], tuple(at - cut for at in goes_on))
        return to, tuple(reversed(out))

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The ids of bytes that belong together, each as soon as it is certain."""
        state = self.start
        for byte in data:
            state, out = state[byte]
            if out:
                yield from out
        yield from self.end(state)

    def ids(self, data: bytes) -> tuple[int, ...]:
        """The same at once."""
        state, ids = self.start, []
        for byte in data:
            state, out = state[byte]
            if out:
                ids += out
        return (*ids, *self.end(state))

    def end(self, state: _State) -> tuple[int, ...]:
        """The ids of the bytes a state keeps, if nothing follows."""
        if state.rest is None:
            out, i = [], len(state.kept)
            while i > 0:
                out.append(self.ranks[state.kept[i - state.last[i - 1] : i]])
                i -= state.last[i - 1]
            state.rest = tuple(reversed(out))
        return state.rest

    def parts(self, text: str) -> list[str]:
        """The pieces within which merging stays."""
        return (self.split_ascii if text.isascii() else self.split).findall(text)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for an empty or null text."""
        if not text:
            return []
        if len(text) <= LONG:
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.parts(text))))
        return [i for m in self.split.finditer(text) for i in self.pieces[m[0]]]

    def count(self, text: str | None) -> int:
        """How many ids a text has."""
        if not text:
            return 0
        if len(text) <= LONG:
            return sum(map(len, map(self.pieces.__getitem__, self.parts(text))))
        return sum(len(self.pieces[m[0]]) for m in self.split.finditer(text))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, as far as its characters are complete; broken ones become U+FFFD."""
        machine, it = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while batch := list(islice(it, 1024)):
            if text := machine.decode(b"".join(map(self.tokens.__getitem__, batch))):
                yield text
        if text := machine.decode(b"", final=True):
            yield text


_loaded: dict[bytes, Transducer] = {}


def load(ranks: bytes) -> Transducer:
    """The transducer of a rank file, kept by the worker process from task to task."""
    key = hashlib.blake2b(ranks).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Transducer(ranks)
    return _loaded[key]
