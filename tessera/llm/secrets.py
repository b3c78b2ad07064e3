"""Credentials written out in code, settings and text: where they stand, and the text without them (problem 4).

A text is taken apart lexically, as a whole, into literals, names and operators; strings and calls may go on over lines. A
literal counts if it is assigned, compared or passed to a name that calls for a credential, or is what such a name falls
back to, unless it is a stand-in, a template, a message or a name itself. Beside literals there are values without quotes
(settings, environments, prose) and credentials that show themselves: private key blocks, issued tokens, passwords in
addresses, headers, queries, connection strings and commands. Only the contents of a literal are replaced; quotes,
escapes, line ends and everything else stay.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from itertools import cycle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.common import iso_ts, latest, norm_key

MARK = "[REDACTED]"

# Prefixes of issued tokens, words that name credentials, words that stand in for a value.
ISSUED = (
    r"sk-(?:live|test|proj|ant|or|svcacct)[-_][A-Za-z0-9_-]{16,}", r"sk-[A-Za-z0-9]{20,}", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", r"whsec_[A-Za-z0-9+/=]{16,}", r"glpat-[A-Za-z0-9_-]{16,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}",
    r"npm_[A-Za-z0-9]{20,}", r"pypi-[A-Za-z0-9_-]{20,}", r"hf_[A-Za-z0-9]{20,}", r"xox[abeoprs]-[A-Za-z0-9-]{16,}", r"xai-[A-Za-z0-9]{20,}", r"AIza[A-Za-z0-9_-]{30,}", r"ya29\.[A-Za-z0-9_-]{20,}", r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"shp(?:at|ss|ca|pa)_[A-Za-z0-9]{20,}", r"do[op]_v1_[A-Za-z0-9]{20,}", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{20,}", r"key-[a-f0-9]{32}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
)
PASSWORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "pw"}
TOKENS = {"secret", "token", "apikey", "credential", "credentials", "bearer", "auth", "authorization", "jwt", "accesskey", "privatekey", "secretkey", "authkey", "authtoken", "pat"}
KEYS = {"api", "access", "secret", "private", "auth", "service", "account", "signing", "encryption", "master", "storage", "client", "deploy", "admin", "shared", "subscription", "license", "app", "webhook", "session", "server", "ssh", "hmac", "jwt"}
NOT_KEYS = {"public", "pub", "cache", "authorized", "primary", "foreign", "sort", "partition"}
LOGINS = {"login", "authenticate", "signin", "basicauth", "credentials"}
READS = {"get", "read", "fetch", "load", "lookup", "resolve", "find", "hash", "has", "is", "check", "validate", "verify", "remove", "delete", "require"}

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_BODY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{8,}={0,3}")
_ISSUED = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(ISSUED) + r")(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+|[^\s\"'`@]*\$\{[^}]*\}[^\s@\"'`]*)@")
_BEARER = re.compile(r"\b[Bb]earer[^\S\n]+([A-Za-z0-9._~+/=-]{12,})")
_BASIC = re.compile(r"\b[Bb]asic[^\S\n]+([A-Za-z0-9+/_-]{8,}={0,2})")
_QUERY = re.compile(r"(?i)[?&;]((?:[a-z]+[_-])*(?:secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|password|passwd|pwd|signature|sig|key))=([^&;#\s\"'`<>]+)")
_SETTING = re.compile(r"(?i)(?:^|[;\"'`\s])((?:password|pwd|accountkey|sharedaccesskey|secret))=([^;\"'`\s]+)(?=;)")
_COMMAND = re.compile(r"\b(?:curl|wget|http)[^\S\n]")
_USER = re.compile(r"(?<=\s)(?:-u|--user(?:=|\s))\s*[\"']?[^\s:\"']+:([^\s\"'`]+)")
_ENV = re.compile(r"(?:^|[\s\"'`;(])(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=([^\s\"'`;,()]+)")
_DEFAULT = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*):?[-=]([^}\s]+)\}")
_PLAIN = re.compile(r"(?m)^(?:[^\S\n]*\d+ \|)?[^\S\n]*(?:- )?[\"']?([A-Za-z_][\w.-]*)[\"']?[^\S\n]*:[^\S\n]+([^\s\"'`{\[|>&*!,;][^\s]*?)[^\S\n]*(?:#.*)?$")
_PROSE = re.compile(r"(?i)\b(password|passwd|pwd|passphrase|passcode|secret|token|api[ -]?key|access[ -]?key)(?:[^\S\n]+(?:is|was|to|for \w+ is))?[^\S\n]*[:=]?[^\S\n]+[\"'`]?([^\s\"'`,;()]{6,})")

#: What an issued token begins with: without one of them ISSUED can't match.
_BEGINNINGS = ("sk-", "sk_", "rk_", "whsec_", "glpat-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "npm_", "pypi-", "hf_", "xox", "xai-", "AIza", "ya29.", "AKIA", "ASIA", "SG.", "shpat_", "shpss_", "shpca_", "shppa_", "dop_v1_", "doo_v1_", "sq0", "key-", "eyJ")
#: What the patterns for prose and for connection strings begin with.
_SAID, _SET = ("password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "api", "access"), ("password", "pwd", "accountkey", "sharedaccesskey", "secret")
#: What every name that calls for a credential has in it, in lower case: without one of them no name can.
_NAMING = ("pass", "pw", "secret", "token", "key", "credential", "bearer", "auth", "jwt", "pat", "login", "sign")

_GUTTER = re.compile(r"(?m)^[^\S\n]*\d+ \|")
#: A literal goes to the end of its line at most, or over lines if it has one word only.
_LITERAL = r"""(?P<text>(?P<q3>\"{3}|'{3}|`)\s*(?P<in3>[^\s"'`]+)\s*(?P=q3)|(?<![A-Za-z0-9])(?P<q>["'`])(?P<in>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q))"""
_LEX = re.compile(_LITERAL + r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>=>|===?|!==?|\|\||\?\?|&&|\?\.|:=|[=:,;()\[\]{}+?])|(?P<other>[^\s\w])""")
_LITERALS = re.compile(_LITERAL)
_JOINED = re.compile(r"""["'`]\s*\+\s*["'`]""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STAND_IN = re.compile(
    r"(?i)^(?:(.)\1*|[x*.•#_-]+|<.*>|\[.*\]|\{.*\}|\(.*\)|none|null|nil|undefined|true|false|todo|tbd|changeme|example|dummy|sample|fake|masked|hidden|password\d{0,3}|passwd|secret\d{0,3}|token\d{0,3}|string|str|xxx.*|.*(?:redact|placeholder|example|\byour[-_ ]?|change[-_ ]?me|replace[-_ ]?me|insert[-_ ]|enter[-_ ]|[-_ ]here\b|xxxx|\*\*\*|\.\.\.|dummy|goes[-_]here).*)$"
)
_TEMPLATE = re.compile(r"\$\{|\{\{|\$\(|#\{|%\(|<[A-Za-z_]|^\$[A-Za-z_]|^%[A-Za-z_]+%$|\{[A-Za-z_][\w.]*\}|^%s$")
#: Parts of a name: words, versions and single digits; a longer number is none.
_WORD = re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+|v\d{1,2}|\d")


def named(name: str) -> str | None:
    """`pass` or `token` for a name that calls for a credential."""
    words = [w.lower() for w in _WORDS.findall(name.rsplit(".", 1)[-1])]
    while words and (words[-1].isdigit() or words[-1] in ("value", "default", "raw")):
        words.pop()
    if not words:
        return None
    last = words[-1]
    if last in PASSWORDS:
        return "pass"
    if last in TOKENS:
        return "token"
    if last == "key" and KEYS & set(words[:-1]) and not NOT_KEYS & set(words):
        return "token"
    return None


def irregular(text: str) -> bool:
    """Letters of both cases in no order a name would have."""
    runs = re.findall(r"[A-Z]?[a-z]+|[A-Z]", text)
    return len(text) >= 10 and text != text.lower() and text != text.upper() and sum(map(len, runs)) / max(1, len(runs)) < 3


def stands(value: str) -> bool:
    """Whether a value is written out: no blank, mask, stand-in or template."""
    return bool(value) and not _STAND_IN.match(value) and not _TEMPLATE.search(value)


def strong(value: str, kind: str) -> bool:
    """Whether a value can be a credential of the kind rather than a message, label, name or path."""
    if not stands(value) or re.search(r"\s", value) or len(value) < (5 if kind == "pass" else 10):
        return False
    parts = [p for p in re.split(r"[-_./:@]+", value) if p]
    if kind == "pass":
        if "://" in value:
            return False
        if all(map(_WORD.fullmatch, parts)):
            return irregular(value)
        return bool(re.search(r"\d|[!#$%^&*?~=+]", value)) or irregular(value)
    if re.match(r"(?:sha\d+|md5|https?|data|urn|file|ssh|vault)[-:]", value) or "://" in value:
        return False
    if all(map(_WORD.fullmatch, parts)):
        return irregular(value)
    return any(len(p) >= 8 and re.search(r"\d", p) and re.search(r"[A-Za-z]", p) for p in parts) or irregular(value) or bool(re.search(r"[0-9a-fA-F]{16}", value))


_TELLING = re.compile(r"[0-9A-Z!#$%^&*?~=+]|[a-f]{16}")


def possible(value: str) -> bool:
    """Whether a value may be `strong` at all, said in short."""
    return len(value) >= 5 and " " not in value and "\n" not in value and bool(_TELLING.search(value))


def _basic(value: str) -> bool:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, secret = text.partition(":")
    return bool(colon and secret.strip()) and text.isprintable() and stands(secret)


def _users(text: str) -> Iterator[re.Match]:
    """The first user with password after each command on its line; each part of a line is read once."""
    at = 0
    while m := _COMMAND.search(text, at):
        end = text.find("\n", m.end())
        user = _USER.search(text, m.end(), len(text) if end < 0 else end)
        at = user.end() if user else m.end()
        if user:
            yield user


def _places(text: str, words: tuple[str, ...]) -> Iterator[int]:
    """Where any of the words stands; plain search is much faster than a pattern over all text."""
    for w in words:
        at = text.find(w)
        while at >= 0:
            yield at
            at = text.find(w, at + 1)


_TAIL = re.compile(r"[\w$.-]*")


def _names(text: str, low: str) -> tuple[bool, set[str]]:
    """Whether a name in the text calls for a credential, or a call for a login; and what follows such a name, blanks and quotes left out."""
    calls, after, seen = False, set(), set()
    for at in _places(low, _NAMING):
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
            start -= 1
        end = _TAIL.match(text, at).end()
        if (start, end) in seen:
            continue
        seen.add((start, end))
        name = text[start:end]
        for part in re.split(r"(?<=[\w$])[.-]+(?=\W|$)|^[.-]+", name):  # a name as the lexer or a pattern may take it
            if part and (named(part) or (words := _words(part)) and (words[-1] in LOGINS or "".join(words[-2:]) in LOGINS)):
                calls = True
                after.add(text[end : end + 3].strip(" \t\"'")[:1])
    return calls, after


def _shown(text: str, low: str, names: tuple[bool, set[str]]) -> Iterator[tuple[int, int]]:
    """Spans of credentials that show themselves, and of values without quotes. `low` is the text in lower case, `names` what `_names` says. What a pattern can't do without is looked for first."""
    for at in _places(text, _BEGINNINGS):
        if (m := _ISSUED.match(text, at)) and stands(m[0]) and not (at and text[at - 1] == "/" and text[m.end() : m.end() + 1] == "/"):
            yield m.span()
    if "://" in text and "@" in text:
        for m in _ADDRESS.finditer(text):
            if stands(m[1]):
                yield m.span(1)
    if "earer" in text:
        for m in _BEARER.finditer(text):
            if strong(m[1], "token"):
                yield m.span(1)
    if "asic" in text:
        for m in _BASIC.finditer(text):
            if _basic(m[1]):
                yield m.span(1)
    if "curl" in text or "wget" in text or "http" in text and (" -u" in text or "--user" in text):
        for m in _users(text):
            if stands(m[1]):
                yield m.span(1)
    if "=" in text and ("?" in text or "&" in text or ";" in text):
        for m in _QUERY.finditer(text):
            if strong(m[2], "pass" if m[1].lower() in PASSWORDS else "token"):
                yield m.span(2)
        for at in _places(low, _SET):
            if (m := _SETTING.match(text, at and at - 1) or _SETTING.match(text, at)) and stands(m[2]) and len(m[2]) > 3:
                yield m.span(2)
    calls, after = names
    if calls and "=" in after:
        for m in _ENV.finditer(text):
            if (kind := named(m[1])) and (strong(m[2], kind) or m[1].isupper() and strong(m[2], "pass")) and not re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)+", m[2]):
                yield m.span(2)
    if calls and "${" in text:
        for m in _DEFAULT.finditer(text):
            if (kind := named(m[1])) and strong(m[2], kind):
                yield m.span(2)
    if calls and ":" in text:
        for m in _PLAIN.finditer(text):
            if (kind := named(m[1])) and strong(m[2], kind):
                yield m.span(2)
    for at in _places(low, _SAID):
        m = _PROSE.match(text, at)
        value = m[2].rstrip(".") if m else ""
        if strong(value, "pass") and (irregular(value) and not re.search(r"[.(]\w", value) or re.search(r"\d", value) and re.search(r"[A-Za-z]", value)) and not re.search(r"[=\[\]{}<>]", value):
            yield m.start(2), m.start(2) + len(value)


class _Tokens:
    """A text taken apart: kind and value of each token, the bracket around each, and where brackets match."""

    def __init__(self, text: str):
        self.found = list(_LEX.finditer(text))
        self.kinds = [m.lastgroup if m.lastgroup in ("name", "op", "other") else "text" for m in self.found]
        self.values = [inside(m) if k == "text" else m[0] for k, m in zip(self.kinds, self.found)]
        self.around, self.partner, open_ = [], {}, []
        for i, (kind, value) in enumerate(zip(self.kinds, self.values)):
            if kind == "op" and value in ")]}" and open_:
                self.partner[i] = open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            if kind == "op" and value in "([{":
                open_.append(i)

    def is_op(self, i: int, *values: str) -> bool:
        return i >= 0 and self.kinds[i] == "op" and self.values[i] in values

    def before(self, i: int) -> int:
        """The token before one, a pair of brackets counting as one."""
        return self.partner.get(i, i) - 1


def inside(m: re.Match) -> str:
    """The contents of a literal."""
    return m["in"] if m["q"] else m["in3"]


def _span(m: re.Match) -> tuple[int, int]:
    return m.span("in") if m["q"] else m.span("in3")


def _literals(text: str) -> Iterator[tuple[int, int]]:
    """Spans of literals that are assigned or passed to a name that calls for a credential, or that it falls back to."""
    values = [inside(m) for m in _LITERALS.finditer(text)]
    if not any(possible(v) and (strong(v, "pass") or strong(v, "token")) or '\\"' in v or "\\'" in v for v in values) and not _JOINED.search(text):
        return
    toks = _Tokens(text)
    i = 0
    while i < len(toks.kinds):
        if toks.kinds[i] != "text":
            i += 1
            continue
        run, j = [i], i + 1
        while j + 1 < len(toks.kinds) and toks.is_op(j, "+") and toks.kinds[j + 1] == "text":
            run.append(j + 1)
            j += 2
        value = "".join(toks.values[k] for k in run)
        kinds = [kind for kind in ("pass", "token") if strong(value, kind)] if possible(value) else ()
        found = bool(kinds) and any(kind in kinds for kind in _kinds(text, toks, i)) or len(run) > 1 and bool(m := _ISSUED.search(value)) and stands(m[0])
        if found:
            yield from (_span(toks.found[k]) for k in run)
        elif '\\"' in value or "\\'" in value:  # code inside a literal
            a, b = _span(toks.found[i])
            turn = cycle((" {}", "{} "))  # the blank outside the inner literal; as long as before, so that places hold
            inner = re.sub(r"\\([\"'])", lambda q: next(turn).format(q[1]), text[a:b])
            yield from ((a + x, a + y) for x, y in _literals(inner))
        i = j


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name.rsplit(".", 1)[-1])]


def _kinds(text: str, toks: _Tokens, i: int) -> set[str]:
    """What the names before a literal call for."""
    kinds, values, out = toks.kinds, toks.values, set()
    j = i - 1
    while toks.is_op(j, "(", "[") and toks.is_op(j - 1, "=", ":", "(", "||", "??", "?"):  # brackets around a value
        j -= 1
    while True:
        if j >= 0 and (toks.is_op(j, "||", "??", "?", "&&") or kinds[j] == "name" and values[j] in ("or", "and", "if", "else")):
            k = toks.before(j)  # what it stands in for, or the condition: with all that is inside its brackets
            while k >= 0 and not toks.is_op(k, "=", ":=", "=>", ",", ";", "(", "[", "{", ":", "||", "??", "?", "&&") and not (kinds[k] == "name" and values[k] in ("or", "and", "return", "else")):
                out |= {named(values[x]) for x in range(toks.partner.get(k, k), k + 1) if kinds[x] in ("name", "text")} if not toks.is_op(j, "?", "&&") else set()
                k = toks.before(k)
                if k >= 0 and kinds[k] != "op" and "\n" in text[toks.found[k].end() : toks.found[k + 1].start()]:
                    break
            j = k
            continue
        if toks.is_op(j, ":"):
            k = toks.before(j)
            while k >= 0 and not toks.is_op(k, "?", "=", ",", ";", "(", "[", "{", ":"):
                k = toks.before(k)
            if toks.is_op(k, "?") and k < j - 1:  # the other branch of a condition
                j = k
                continue
        break
    if toks.is_op(j, "=", ":", "=>", ":=", "==", "===", "!=", "!=="):
        k = j - 1
        while toks.is_op(k, "]", "?", ")"):
            k -= 1
        if k >= 0 and kinds[k] in ("name", "text"):
            out.add(named(values[k]))
            if values[j] == "=" and k >= 2 and values[k - 1] == ":" and kinds[k - 2] == "name":
                out.add(named(values[k - 2]))
    elif toks.is_op(j, ",") and j == i - 1:
        caller = toks.around[j]
        called = toks.is_op(caller, "(") and caller > 0 and kinds[caller - 1] == "name"
        if j and kinds[j - 1] == "text" and (called or "\n" not in text[toks.found[j].end() : toks.found[i].start()]):
            out.add(named(values[j - 1]))
        if called and (words := _words(values[caller - 1])) and (words[-1] in LOGINS or "".join(words[-2:]) in LOGINS):
            out.add("pass")
    elif toks.is_op(j, "(") and j and kinds[j - 1] == "name":
        words = _words(values[j - 1])
        if not words or words[0] not in READS:
            out.add(named(values[j - 1]))
            if j >= 3 and values[j - 2] in ("=", ":"):
                out.add(named(values[j - 3]))
    return {kind for kind in out if kind}


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start of the credential, start and end of contents to replace), in order, without overlap.

    A key block has one start, its BEGIN line, and a span for each run of its body. None for a null text.
    """
    if not text:
        return []
    found, blocks = [], []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            end = text.find(f"-----END {m[1]}-----", m.end())
            stop = _PEM.search(text, m.end())
            if end < 0 or stop and stop.start() < end:
                end = stop.start() if stop else len(text)
                body = re.match(r"(?:(?:\\r|\\n|\s|\d+ \||[#*/>\"'+]|[A-Za-z0-9+/=]{16,})+)", text[m.end() : end])
                end = m.end() + (body.end() if body else 0)
            body = [b for b in _BODY.finditer(text.replace("\\n", "  ").replace("\\r", "  "), m.end(), end) if not b[0].isdigit()]
            if sum(len(b[0]) for b in body) >= 24:
                blocks.append((m.start(), end))
                found += [(m.start(), b.start(), b.end()) for b in body]
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(c.lower() if c.isascii() else c for c in text)
    names = _names(text, low)
    found += [(x, x, y) for x, y in _shown(text, low, names)]
    if ('"' in text or "'" in text or "`" in text) and (names[0] or '\\"' in text or "\\'" in text) or "+" in text and _JOINED.search(text):
        plain = _GUTTER.sub(lambda m: " " * len(m[0]), text) if " |" in text else text  # numbers of lines are no tokens
        found += [(x, x, y) for x, y in _literals(plain)]
    out: list[tuple[int, int, int]] = []
    for s, x, y in sorted(set(found), key=lambda f: (f[1], -f[2])):
        if out and x < out[-1][2]:
            continue
        if s == x and any(lo <= x < hi for lo, hi in blocks):
            continue
        out.append((s, x, y))
    return out


def lines(text: str | None) -> list[int]:
    """The lines, counted from 1, on which credentials start."""
    found = spans(text)
    return sorted({text.count("\n", 0, s) + 1 for s, _, _ in found})


def cleared(text: str | None) -> tuple[int, str] | None:
    """How many places were replaced, and the text with each credential's contents replaced; null if there is none to replace."""
    found = spans(text)
    if not found:
        return None
    out, at = [], 0
    for _, x, y in found:
        out += [text[at:x], MARK]
        at = y
    return len(found), "".join([*out, text[at:]])


def redacted(text: str | None) -> str | None:
    """The text of `cleared`."""
    return (cleared(text) or (0, None))[1]


def lines_of(text: Column) -> Column:
    """`lines` as array<int>; empty for a null or empty text."""

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([lines(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return find(text)


def redaction_of(text: Column) -> Column:
    """`redacted` and how many places were replaced, as a struct; null where nothing was."""

    @F.arrow_udf("struct<redactions:int,text:string>")
    def redact(texts: pa.Array) -> pa.Array:
        rows = [dict(zip(("redactions", "text"), new)) if (new := cleared(t.as_py())) else None for t in texts]
        return pa.array(rows, pa.struct([("redactions", pa.int32()), ("text", pa.string())]))

    return redact(text)


def found(records: DataFrame, name: str, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """Columns `rec_table, rec_id, line_no`: each line of the current text of each record on which a credential starts.

    Texts stay where they are read: only the numbers of lines are grouped by record. Of rows with one id (without
    case and blanks) the latest holds; rows without id are left out; null and empty texts have no lines.
    """
    scanned = records.select(F.col(id_col).alias("id"), F.col(at_col).alias("at"), lines_of(F.col(text_col)).alias("lines"))
    held = latest(scanned, norm_key("id"), iso_ts("at"), ["lines"])
    return held.select(F.lit(name).alias("rec_table"), F.col("key").alias("rec_id"), F.explode("lines").alias("line_no"))


def cleaned(records: DataFrame, name: str, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """Columns `rec_table, rec_id, redactions, text` of records with credentials; the rest of each text is unchanged.

    Only texts in which something was replaced are moved.
    """
    scanned = records.select(F.col(id_col).alias("id"), F.col(at_col).alias("at"), redaction_of(F.col(text_col)).alias("new"))
    held = latest(scanned, norm_key("id"), iso_ts("at"), ["new"]).where("new is not null")
    return held.select(F.lit(name).alias("rec_table"), F.col("key").alias("rec_id"), "new.redactions", "new.text")
