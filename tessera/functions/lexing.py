"""A small lexer for TypeScript, JavaScript and Python: tokens with their lines and matching brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/|(?<![\w"'`)\]])\#[^\n]*)|(?P<string>\"{3}.*?\"{3}|'{3}.*?'{3}|[rbfu]{0,2}"(?:\\.|[^"\\\n])*"|[rbfu]{0,2}'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<regex>(?<=[(=,:!&|?\[{;])\s*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[gimsuy]*)|(?P<number>(?<![\w.])\d[\d_]*(?:\.\d+)?(?:e[+-]?\d+)?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<newline>\n)"""
    r"""|(?P<op>=>|\.\.\.|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|//|\*\*|:=|[-+*/%<>=!?:;,.()\[\]{}&|^~@])""",
    re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Lexed:
    """Tokens of a text without comments: kinds, values, lines counted from 1, bracket depth, and the other end of each bracket."""

    kinds: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)
    indent: dict[int, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.kinds)

    def is_(self, i: int, *values: str) -> bool:
        return 0 <= i < len(self.values) and self.kinds[i] != "string" and self.values[i] in values

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < len(self.kinds) else ""

    def text(self, a: int, b: int) -> str:
        """Tokens a to b, put together without blanks except between words."""
        out = ""
        for k in range(a, b):
            v = self.values[k]
            out += " " + v if out and out[-1].isalnum() and (v[0].isalnum() or v[0] in "_\"'`") else v
        return out


def lexed(text: str) -> Lexed:
    """The tokens of a text; `indent` has the column of the first token of each line. Brackets that don't match have no other end."""
    out, line, at, fresh, open_ = Lexed(), 1, 0, True, []
    start = 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup
        if kind == "newline":
            line, at, fresh, start = line + 1, m.end(), True, m.end()
            continue
        if kind == "comment":
            continue
        value = m[0].strip()
        i = len(out.kinds)
        if fresh:
            out.indent[line] = m.start() - start
            fresh = False
        if kind == "op" and value in _CLOSE and open_:
            j = open_.pop()
            out.partner[i], out.partner[j] = j, i
        out.kinds.append(kind)
        out.values.append(value)
        out.lines.append(line)
        out.depth.append(len(open_))
        if kind == "op" and value in _OPEN:
            open_.append(i)
    return out


def written(value: str) -> str:
    """What a string literal says."""
    v = value.lstrip("rbfu") if value[:1] in "rbfu" else value
    return v[3:-3] if v[:3] in ('"""', "'''") and len(v) >= 6 else v[1:-1]
