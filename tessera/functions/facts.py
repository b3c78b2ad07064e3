"""Facts about a unit of code, taken from its tokens; rules over the facts are columns.

A unit is lexed once (`lexing.py`) and read with its brackets and blocks: what its conditions test and where what they
read comes from, what it returns, which arms it has and what it does. The extractor stands behind one function,
`facts_of`; everything after it is native.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lexing import Lexed, lexed, written

#: How many assignments are followed back to see where a value comes from.
TRACE = 4

_TEXT_METHODS = {"includes", "startsWith", "endsWith", "indexOf", "startswith", "endswith", "find", "toLowerCase", "toUpperCase", "lower", "upper", "trim", "strip", "charAt", "charCodeAt", "localeCompare"}
_TESTS = {"test", "match", "search", "exec", "matchAll", "fullmatch"}
_SELECT = {"filter", "find", "sort", "slice", "findIndex", "findLast", "some", "every", "sorted", "max", "min"}
_TEXT_OPS = {"split", "replace", "replaceAll", "toLowerCase", "toUpperCase", "trim", "lower", "upper", "strip", "substring", "substr", "join"}
_EVENTS = {"e", "ev", "evt", "event"}
_EVENT_FIELDS = {"key", "keyCode", "code", "button", "clientX", "clientY", "deltaY", "altKey", "ctrlKey", "metaKey", "shiftKey", "pointerType"}
_NOTHING = {"null", "undefined", "None", "true", "false", "True", "False", "NaN"}
_BLANKS = {"if", "elif", "else", "while", "for", "return", "throw", "raise", "switch", "case", "default", "const", "let", "var", "function", "def", "new", "typeof", "instanceof", "in", "not", "and", "or", "is", "await", "async", "of", "try", "catch", "except", "lambda", "void", "delete", "yield", "class", "extends", "import", "from", "export", "as", "with", "pass", "break", "continue", "finally"}


_WRAPPERS = {"len", "str", "int", "float", "bool", "list", "set", "String", "Number", "Boolean", "parseInt", "parseFloat", "isinstance", "isNaN"}
_BRANCH = {"if", "elif", "while"}


class _Unit:
    """One unit's tokens, and where its names come from."""

    def __init__(self, code: str):
        self.t: Lexed = lexed(code)
        self.origin: dict[str, str] = {}
        self.source: dict[str, tuple[int, int]] = {}  # what a name was last set to
        self.closed: set[str] = set()
        self.textual: set[str] = set()
        self.numeric: set[str] = set()
        self.params = self._signature()
        self._bindings()

    def _signature(self) -> list[str]:
        """The names of the parameters of the first function, and what their types say."""
        t, i = self.t, 0
        while i < len(t) and not t.is_(i, "("):
            if t.is_(i, "=>") or t.is_(i, "{"):
                return []
            i += 1
        end, names, k = t.partner.get(i, i), [], i + 1
        while k < end:
            if t.kind(k) == "name" and t.values[k] not in _BLANKS and (t.is_(k - 1, "(", ",", "{", "[", "...", "*", "**") or t.is_(k - 1, ":") and t.depth[k] > t.depth[i] + 1):
                name = t.values[k]
                names.append(name)
                self.origin[name] = "ui_event" if name in _EVENTS else "request_input" if name in ("req", "request") else "parameter"
                if t.is_(k + 1, ":") or t.is_(k + 2, ":") and t.is_(k + 1, "?"):
                    a = k + 2 if t.is_(k + 1, ":") else k + 3
                    b = a
                    while b < end and not (t.is_(b, ",", "=") and t.depth[b] <= t.depth[k]):
                        b += 1
                    kind = t.text(a, b)
                    if re.search(r"^[\"']|\|\s*[\"']|^bool(ean)?$|^Literal", kind):
                        self.closed.add(name)
                    if re.match(r"string$|str$", kind):
                        self.textual.add(name)
                    if re.match(r"number$|int$|float$|bigint$", kind):
                        self.numeric.add(name)
                    k = b - 1
            k += 1
        return [n for n in dict.fromkeys(names) if n not in ("self", "this", "cls")]

    def _bindings(self) -> None:
        t = self.t
        for i in range(len(t)):
            if t.is_(i, "catch") and t.is_(i + 1, "(") and t.kind(i + 2) == "name":
                self.origin[t.values[i + 2]] = "caught_error"
            elif t.is_(i, "except"):
                k = i
                while k < len(t) and not t.is_(k, ":"):
                    if t.is_(k, "as") and t.kind(k + 1) == "name":
                        self.origin[t.values[k + 1]] = "caught_error"
                    k += 1
            elif t.kind(i) == "name" and t.is_(i + 1, "=") and not t.is_(i - 1, ".") and t.values[i] not in self.origin:
                self.source.setdefault(t.values[i], (i + 2, self.end(i + 2)))

    def end(self, i: int) -> int:
        """The end of the expression that begins at a token: a semicolon, comma or new line outside its brackets."""
        t, start = self.t, i
        while i < len(t):
            if t.is_(i, ";", ",", ")", "]", "}") or i > start and t.lines[i] != t.lines[i - 1] and not t.is_(i, ".", "?.", "&&", "||", "??", "?", ":", "+") and not t.is_(i - 1, "=", "(", "&&", "||", "??", "?", ":", "+", ".", "=>"):
                return i
            i = t.partner.get(i, i) + 1 if t.is_(i, "(", "[", "{") else i + 1
        return i

    def comes_from(self, a: int, b: int, left: int = TRACE) -> tuple[str, str]:
        """(name, provenance) of what an expression reads: its first name that isn't a word of the language."""
        t = self.t
        for i in range(a, b):
            if t.kind(i) != "name" or t.values[i] in _BLANKS or t.values[i] in _NOTHING or t.is_(i - 1, ".", "?."):
                continue
            name, k = t.values[i], i + 1
            while t.is_(k, ".", "?.") and t.kind(k + 1) == "name" and k + 1 < b:
                name += "." + t.values[k + 1]
                k += 2
            if t.is_(k, "(") and "." not in name and name in _WRAPPERS:
                continue
            if t.is_(k, "(") and "." in name:  # a method says nothing about where its object comes from
                name = name.rpartition(".")[0]
            root, field_ = name.split(".")[0], name.split(".")[-1]
            if re.match(r"process\.env|os\.(environ|getenv)|import\.meta\.env|config\b|settings\b", name):
                return name, "env_config"
            if root in ("this", "self"):
                return name, "instance_state"
            if re.match(r"(req|request)\.(body|query|params|headers|form|json|args)", name):
                return name, "request_input"
            origin = self.origin.get(root)
            if origin == "parameter" and field_ in _EVENT_FIELDS and root in _EVENTS:
                origin = "ui_event"
            if origin:
                return name, origin
            if root in self.source and left:
                x, y = self.source[root]
                if t.is_(x, "await"):
                    return name, "awaited_call"
                if y - x == 1 and t.kind(x) in ("string", "number"):
                    return name, "constant"
                _, origin = self.comes_from(x, y, left - 1)
                calls = any(t.is_(j, "(") and t.kind(j - 1) == "name" and t.values[j - 1] not in _TEXT_METHODS | _TEXT_OPS for j in range(x, y))
                return name, "call_result" if calls and origin in ("unknown", "constant") else origin
            if root.isupper() and len(root) > 1:
                return name, "constant"
            if t.is_(k, "("):
                return name, "call_result"
            return name, "unknown"
        return "", "constant" if any(t.kind(i) in ("string", "number") for i in range(a, b)) else "unknown"

    def atoms(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts of a condition between its connectives, without brackets around them and without negation."""
        t = self.t
        while a < b and (t.is_(a, "!", "not") or t.is_(a, "(") and t.partner.get(a) == b - 1):
            a, b = (a + 1, b) if t.is_(a, "!", "not") else (a + 1, b - 1)
        start, i, parts = a, a, []
        while i < b:
            if t.is_(i, "&&", "||", "and", "or", "??"):
                parts.append((start, i))
                start = i + 1
            i = t.partner.get(i, i) + 1 if t.is_(i, "(", "[", "{") else i + 1
        if parts:
            for x, y in (*parts, (start, b)):
                yield from self.atoms(x, y)
        elif a < b:
            yield a, b

    def shape(self, a: int, b: int) -> str:
        """What kind of test an atom is."""
        t = self.t
        inside = range(a, b)
        calls = {t.values[i - 1] for i in inside if t.is_(i, "(") and t.kind(i - 1) == "name" and i > a}
        strings, numbers = any(t.kind(i) == "string" for i in inside), any(t.kind(i) == "number" for i in inside)
        if any(t.kind(i) == "regex" for i in inside) or calls & _TESTS and strings or any(t.is_(i, "re") for i in inside) and calls & _TESTS:
            return "regex"
        if calls & {"includes", "has", "indexOf", "some"} or any(t.is_(i, "in") for i in inside):
            return "text_method" if calls & {"includes", "indexOf"} and strings and not t.is_(a, "[") else "membership"
        if calls & _TEXT_METHODS and strings:
            return "text_method"
        compare = [i for i in inside if t.is_(i, "<", ">", "<=", ">=") and t.depth[i] == t.depth[a]]
        if compare:
            left, right = t.text(a, compare[0]), t.text(compare[0] + 1, b)
            return "trivial" if re.search(r"\.length$|^len\(", left) and right in ("0", "1") else "relational"
        equal = [i for i in inside if t.is_(i, "==", "===", "!=", "!==", "is")]
        if equal:
            if any(t.is_(i, *_NOTHING) for i in inside) or t.is_(a, "typeof") or re.search(r"\.length$|^len\(", t.text(a, equal[0])):
                return "trivial"
            return "exact_literal" if strings or numbers or any(t.kind(i) == "name" and t.values[i].isupper() for i in inside) else "call" if calls else "relational"
        if any(t.is_(i, "instanceof") for i in inside) or calls & {"isArray", "isinstance", "isNaN", "Boolean", "hasattr"}:
            return "trivial"
        return "call" if calls else "trivial"

    def condition(self, a: int, b: int, line: int, exits: bool) -> dict:
        t, shapes, operands = self.t, [], {}
        parts = list(self.atoms(a, b))
        for x, y in parts:
            shapes.append(self.shape(x, y))
            name, origin = self.comes_from(x, y)
            if name:
                root = name.split(".")[0]
                operands.setdefault(name, {"name": name, "provenance": origin, "closed": name in self.closed, "textual": root in self.textual or shapes[-1] in ("text_method", "regex"), "numeric": root in self.numeric or shapes[-1] == "relational"})
        strings = [written(t.values[i]) for i in range(a, b) if t.kind(i) == "string"]
        numbers = [float(t.values[i].replace("_", "")) for i in range(a, b) if t.kind(i) == "number"]
        single = any(len(s) == 1 for s in strings) and "exact_literal" in shapes or any(t.is_(i, "charCodeAt", "ord") for i in range(a, b))
        return {"line": line, "shapes": shapes, "atoms": len(parts), "operands": list(operands.values()), "strings": strings, "numbers": numbers, "char_compare": single, "exits": exits}

    def choices(self, a: int, b: int) -> list[tuple[int, int]]:
        """The values an expression chooses between, or itself."""
        t, marks, i = self.t, [], a
        while i < b:
            if t.is_(i, "?", ":", "if", "else"):
                marks.append(i)
            i = t.partner.get(i, i) + 1 if t.is_(i, "(", "[", "{") else i + 1
        if len(marks) == 2 and t.is_(marks[0], "?"):
            return [(marks[0] + 1, marks[1]), (marks[1] + 1, b)]
        if len(marks) == 2 and t.is_(marks[0], "if"):
            return [(a, marks[0]), (marks[1] + 1, b)]
        return [(a, b)]

    def value_kind(self, a: int, b: int) -> str:
        """What a returned expression is."""
        t = self.t
        if a >= b:
            return "nothing"
        if t.is_(a, "<") and t.kind(a + 1) == "name" or t.is_(a, "(") and t.is_(a + 1, "<"):
            return "jsx"
        one = b - a == 1 or b - a == 2 and t.is_(a, "-")
        last = t.kind(b - 1)
        if one and last in ("string", "number"):
            return last
        if one and t.values[a] in ("true", "false", "True", "False"):
            return "boolean"
        if t.is_(a, "{"):
            return "object"
        if t.is_(a, "!", "not") or any(t.is_(i, "===", "!==", "==", "!=", "<", ">", "<=", ">=", "&&") and t.depth[i] == t.depth[a] for i in range(a, b)):
            return "boolean"
        if last == "name" and all(t.kind(i) == "name" or t.is_(i, ".") for i in range(a, b)):
            return "enum" if b - a == 3 and t.values[a][:1].isupper() else "identifier"
        if any(t.is_(i, "+", "-", "*", "/") and t.depth[i] == t.depth[a] for i in range(a, b)):
            return "arithmetic"
        return "call" if t.is_(b - 1, ")") else "other"


def _conditions(u: _Unit) -> Iterator[tuple[int, int, int]]:
    """(start, end, first token after) of the tests of branches, loops and choices between two values."""
    t = u.t
    for i in range(len(t)):
        if t.is_(i, "if", "elif", "while") and not t.is_(i - 1, "."):
            if t.is_(i + 1, "(") and (end := t.partner.get(i + 1)) and (not t.is_(end + 1, ":", "and", "or", "==", "!=", "<", ">", ".", "in")):
                yield i + 2, end, end + 1
            else:
                k = i + 1
                while k < len(t) and not (t.is_(k, ":", "else", "]", ")") and t.depth[k] <= t.depth[i]):
                    k = t.partner.get(k, k) + 1 if t.is_(k, "(", "[", "{") else k + 1
                yield i + 1, k, k + 1
        elif t.is_(i, "?") and not t.is_(i + 1, ":", ")", ",", ".") and t.kind(i - 1) != "":
            k = i - 1
            while k >= 0 and not (t.is_(k, "=", "(", "[", "{", ",", ";", ":", "=>", "return", "?") and k not in u.t.partner or t.is_(k, "(", "[", "{") and k in t.partner and t.partner[k] > i):
                k = t.partner.get(k, k) - 1 if t.is_(k, ")", "]", "}") else k - 1
                if k >= 0 and t.is_(k, "}"):
                    break
            yield k + 1, i, i + 1


def facts(code: str | None) -> dict | None:
    """The facts of one unit; null for a null or blank one."""
    if not code or not code.strip():
        return None
    u = _Unit(code)
    t = u.t
    conditions, ternaries, inside = [], 0, set()
    for a, b, after in _conditions(u):
        if a < b:
            body = after + 1 if t.is_(after, "{") else after
            ternary = t.is_(after - 1, "?")
            ternaries += ternary or t.is_(b, "else")
            conditions.append(u.condition(a, b, t.lines[a], t.is_(body, "return", "throw", "raise", "continue", "break")))
            if t.is_(after, "{"):
                inside |= set(range(after, t.partner.get(after, after)))
    returns, arms, assigned, calls, tested = [], [], {}, {}, {c["line"] for c in conditions}
    counts = dict.fromkeys(("statements", "awaits", "throws", "loops", "arithmetic", "accumulations", "weighted_terms", "selector_ops", "text_ops"), 0)
    for i in range(len(t)):
        v = t.values[i]
        named = t.kind(i) == "name"
        if named and v == "return":
            end = u.end(i + 1) if t.lines[min(i + 1, len(t) - 1)] == t.lines[i] else i + 1
            for x, y in u.choices(i + 1, end):
                kind = u.value_kind(x, y)
                returns.append({"line": t.lines[i], "kind": kind, "value": (written(t.values[x]) if kind == "string" else t.text(x, y))[:80]})
        elif named and v == "switch" and t.is_(i + 1, "("):
            end = t.partner.get(i + 1, i + 1)
            name, origin = u.comes_from(i + 2, end)
            arms.append({"line": t.lines[i], "discriminant": name, "provenance": origin, "closed": name in u.closed, "values": [], "effects": []})
        elif named and v in ("case", "default") and arms and (t.is_(i + 2, ":") or t.is_(i + 1, ":") or v == "case"):
            k = i
            while k < len(t) and not t.is_(k, ":"):
                k += 1
            if v == "case":
                arms[-1]["values"].append(written(t.values[i + 1]) if t.kind(i + 1) == "string" else t.text(i + 1, k))
            if k + 1 < len(t) and not t.is_(k + 1, "case", "default", "}"):
                arms[-1]["effects"].append(t.text(k + 1, min(u.end(k + 1), k + 9)))
        elif named and t.is_(i + 1, "(") and v not in _BLANKS:
            calls[v] = calls.get(v, 0) + 1
            counts["selector_ops"] += v in _SELECT and t.is_(i - 1, ".") or v in ("sorted", "max", "min")
            counts["text_ops"] += v in _TEXT_OPS
        if named:
            counts["awaits"] += v == "await"
            counts["throws"] += v in ("throw", "raise")
            counts["loops"] += v in ("for", "while") or v in ("forEach", "map", "reduce") and t.is_(i + 1, "(")
        if v in ("+", "-", "*", "/", "%", "**") and t.kind(i) == "op" and (t.kind(i - 1) in ("name", "number") or t.is_(i - 1, ")", "]")) and t.kind(i + 1) != "string" and t.kind(i - 1) != "string":
            counts["arithmetic"] += 1
            counts["weighted_terms"] += v == "*" and (t.kind(i - 1) == "number" or t.kind(i + 1) == "number")
        if v in ("+=", "-=") and t.kind(i) == "op" and t.kind(i + 1) == "number":
            counts["accumulations"] += i in inside or t.is_(i - 2, ")", ":") or t.lines[i] in tested or t.lines[i] - 1 in tested and "{" not in t.values
        if v == "=" and t.kind(i) == "op" and t.kind(i - 1) == "name" and t.kind(i + 1) == "string" and (t.is_(i + 2, ";") or i + 2 >= len(t) or t.lines[i + 2] != t.lines[i + 1]):
            assigned.setdefault(t.values[i - 1], []).append(written(t.values[i + 1]))
        counts["statements"] += t.is_(i, ";") or i in (0,) or t.lines[i] != t.lines[i - 1] and not t.is_(i, "}", ")", "]")
    lines = code.count("\n") + 1
    deepest, depth = (0 if "{" in t.values else max(t.indent.values(), default=0) // 4), 0
    for i, v in enumerate(t.values):
        if v in "{}" and t.kinds[i] == "op":
            depth += 1 if v == "{" else -1
            deepest = max(deepest, depth)
    ordering = [r["value"] for r in returns if r["kind"] != "number"]
    comparator = len(u.params) == 2 and bool(ordering) and all("localeCompare" in v or "-" in v and "*" not in v and all(re.search(rf"\b{re.escape(p)}\b", v) for p in u.params) for v in ordering)
    return {
        "conditions": conditions, "returns": returns, "arms": arms, "params": u.params, "calls": list(calls), "assigned": [x for values in assigned.values() if len(set(values)) >= 2 for x in dict.fromkeys(values)],
        "lines": lines, "max_depth": deepest, "ternaries": ternaries, "comparator": comparator, "strings": sum(k == "string" for k in t.kinds), **counts,
    }


_OPERAND = [("name", pa.string()), ("provenance", pa.string()), ("closed", pa.bool_()), ("textual", pa.bool_()), ("numeric", pa.bool_())]
_CONDITION = [("line", pa.int32()), ("shapes", pa.list_(pa.string())), ("atoms", pa.int32()), ("operands", pa.list_(pa.struct(_OPERAND))), ("strings", pa.list_(pa.string())), ("numbers", pa.list_(pa.float64())), ("char_compare", pa.bool_()), ("exits", pa.bool_())]
_ARM = [("line", pa.int32()), ("discriminant", pa.string()), ("provenance", pa.string()), ("closed", pa.bool_()), ("values", pa.list_(pa.string())), ("effects", pa.list_(pa.string()))]
_COUNTS = ("lines", "max_depth", "ternaries", "strings", "statements", "awaits", "throws", "loops", "arithmetic", "accumulations", "weighted_terms", "selector_ops", "text_ops")
_ARROW = pa.struct(
    [
        ("conditions", pa.list_(pa.struct(_CONDITION))),
        ("returns", pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))),
        ("arms", pa.list_(pa.struct(_ARM))),
        *((n, pa.list_(pa.string())) for n in ("params", "calls", "assigned")),
        *((n, pa.int32()) for n in _COUNTS),
        ("comparator", pa.bool_()),
    ]
)
SHAPE = (
    "struct<conditions:array<struct<line:int,shapes:array<string>,atoms:int,operands:array<struct<name:string,provenance:string,closed:boolean,textual:boolean,numeric:boolean>>,strings:array<string>,numbers:array<double>,char_compare:boolean,exits:boolean>>,"
    "returns:array<struct<line:int,kind:string,value:string>>,arms:array<struct<line:int,discriminant:string,provenance:string,closed:boolean,values:array<string>,effects:array<string>>>,params:array<string>,calls:array<string>,assigned:array<string>," + ",".join(f"{c}:int" for c in _COUNTS) + ",comparator:boolean>"
)


def facts_of(code: Column) -> Column:
    """`facts` as a struct column."""

    @F.arrow_udf(SHAPE)
    def run(codes: pa.Array) -> pa.Array:
        return pa.array([facts(c.as_py()) for c in codes], _ARROW)

    return run.asNondeterministic()(code)


def _only(c: Column, *shapes: str) -> Column:
    return F.forall(c["shapes"], lambda s: s.isin(*shapes))


def decisive(f: Column) -> Column:
    """Conditions that decide something: all but guards."""
    return F.filter(f["conditions"], lambda c: ~_only(c, "trivial"))


def operands(conditions: Column) -> Column:
    return F.flatten(conditions["operands"])


def literal_outcomes(f: Column) -> Column:
    """Distinct outcomes written out: returned literals, and literals a name is set to in several places."""
    returned = F.transform(F.filter(f["returns"], lambda r: r["kind"].isin("string", "number", "boolean", "enum")), lambda r: r["value"])
    return F.array_distinct(F.concat(returned, f["assigned"]))


def output_kind(f: Column) -> Column:
    """What a unit decides on: the kind all its returns have, or mixed; an action if it returns nothing."""
    kinds = F.array_distinct(F.transform(F.filter(f["returns"], lambda r: r["kind"] != "nothing"), lambda r: F.when(r["kind"].isin("string", "enum"), "enumerated").when(r["kind"].isin("number", "arithmetic"), "numeric").when(r["kind"].isin("boolean", "object"), r["kind"]).otherwise("unknown")))
    one = F.element_at(kinds, 1)
    return F.when(F.size(kinds) == 0, F.when(F.size(f["assigned"]) >= 2, "enumerated").otherwise("action")).when(F.size(kinds) > 1, "mixed").otherwise(one)


def outcomes(f: Column, most: int = 12) -> Column:
    """The outcomes: those written out, else what the arms do."""
    literal, effects = literal_outcomes(f), F.array_distinct(F.flatten(f["arms"]["effects"]))
    return F.slice(F.when((output_kind(f) == "action") | (F.size(literal) == 0), effects).otherwise(literal), 1, most)


def inputs(f: Column, most: int = 12) -> Column:
    """What the decision reads: operands of what decides, what is dispatched on, then parameters not among them, also not as the beginning of one."""
    read = F.array_distinct(F.concat(operands(decisive(f))["name"], F.filter(f["arms"]["discriminant"], lambda x: x != "")))
    rest = F.filter(f["params"], lambda p: ~F.exists(read, lambda r: (r == p) | r.startswith(F.concat(p, F.lit("."))) | r.startswith(F.concat(p, F.lit("[")))))
    return F.slice(F.concat(read, rest), 1, most)


def generators(f: Column) -> Column:
    """The names of the rules by which a unit is proposed as a decision; a unit with none isn't."""
    d = decisive(f)
    shapes = F.flatten(f["conditions"]["shapes"])
    widest = F.coalesce(F.array_max(F.transform(f["arms"], lambda a: F.size(a["values"]))), F.lit(0))
    rules = {
        "outcome-set": (F.size(literal_outcomes(f)) >= 2) & (F.size(f["conditions"]) + F.size(f["arms"]) >= 1),
        "branch-map": widest >= 3,
        "selector": (f["selector_ops"] >= 2) & (F.size(d) >= 1),
        "scorer": f["accumulations"] + f["weighted_terms"] >= 2,
        "gate": F.size(F.filter(d, lambda c: c["exits"])) >= 2,
        "text-match": F.arrays_overlap(shapes, F.array(F.lit("regex"), F.lit("text_method"))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def triage(f: Column, fired: Column) -> Column:
    """Why a proposed unit is none after all: the first of twelve named rules that holds, null if none does."""
    d, read = decisive(f), operands(decisive(f))
    some = lambda *names: F.arrays_overlap(fired, F.array(*map(F.lit, names)))
    every = lambda origin: (F.size(read) > 0) & F.forall(read, lambda o: o["provenance"] == origin)
    told = F.filter(f["arms"], lambda a: a["discriminant"] != "")
    exact = (F.size(d) + F.size(told) > 0) & F.forall(d, lambda c: _only(c, "exact_literal", "trivial"))
    closed = (F.size(read) + F.size(told) > 0) & F.forall(read, lambda o: o["closed"]) & F.forall(told, lambda a: a["closed"])
    chars = F.size(F.filter(d, lambda c: c["char_compare"]))
    strings, numbers = F.flatten(d["strings"]), F.flatten(d["numbers"])
    status = F.exists(read, lambda o: o["name"].rlike(r"\.(status|statusCode|status_code)$"))
    plain = F.forall(d, lambda c: _only(c, "trivial", "call"))
    jsx = F.exists(f["returns"], lambda r: r["kind"] == "jsx")
    computed = (F.size(f["returns"]) > 0) & F.forall(f["returns"], lambda r: r["kind"].isin("number", "arithmetic", "identifier", "other", "call"))
    return (
        F.when(f["comparator"], "sorting_filtering")
        .when((F.size(d) == 0) & (F.size(told) == 0) & ~some("scorer", "selector") & ~(computed & (f["arithmetic"] >= 2)), "trivial_guard")
        .when(every("caught_error"), "library_error_text")
        .when(every("env_config"), "feature_flag")
        .when(exact & closed, "enum_dispatch")
        .when((chars >= 2) & (chars * 2 >= F.size(d)), "parsing")
        .when((F.size(strings) >= 2) & F.forall(strings, lambda s: s.rlike(r"(?i)^(\.[a-z0-9]{1,6}|[a-z]+/[a-z0-9.+*-]+)$")), "file_type")
        .when((F.size(numbers) >= 2) & status & F.forall(numbers, lambda n: (n == F.floor(n)) & n.between(100, 599)), "protocol_status")
        .when(every("ui_event"), "ui_plumbing")
        .when(computed & (F.size(d) == 0) & (f["arithmetic"] >= 2), "arithmetic")
        .when(jsx & plain & ~some("scorer", "text-match"), "ui_plumbing")
        .when(plain & (F.size(told) == 0) & ~some("scorer", "selector", "text-match") & (F.size(literal_outcomes(f)) < 2), "trivial_guard")
    )


def suggestion(f: Column, fired: Column) -> Column:
    """The primitive an outcome calls for: a graded number is a score, yes or no a noul, one of several known outcomes a choice."""
    kind, n = output_kind(f), F.size(outcomes(f, 1000))
    scores, selects = F.array_contains(fired, "scorer"), F.array_contains(fired, "selector")
    several = n.between(2, 255)
    return (
        F.when(scores & kind.isin("numeric", "unknown"), "score")
        .when(kind == "boolean", "noul")
        .when(several & (kind.isin("enumerated", "object", "action", "mixed") | (kind == "numeric") & ~scores), "choice")
        .when(scores, "score")
        .when(selects, "choice")
        .otherwise("none")
    )


def explanation(name: Column, f: Column, fired: Column) -> Column:
    """One sentence about what a unit decides from what."""
    kind, read = output_kind(f), inputs(f)
    verb = F.when(kind == "boolean", "decides yes or no").when(suggestion(f, fired) == "score", "computes a level").when(kind == "action", "chooses an action").otherwise("chooses one outcome")
    shown = F.when(F.size(read) == 0, "no explicit inputs").otherwise(F.concat(F.array_join(F.slice(read, 1, 4), ", "), F.when(F.size(read) > 4, F.concat(F.lit(", +"), (F.size(read) - 4).cast("string"))).otherwise("")))
    return F.concat(F.coalesce(name, F.lit("unit")), F.lit(" "), verb, F.lit(" from "), shown)


# Kinds of tests and origins of inputs that are counted one by one.
SHAPES = ("trivial", "exact_literal", "relational", "text_method", "regex", "membership", "call")
ORIGINS = ("parameter", "request_input", "awaited_call", "call_result", "instance_state", "ui_event", "caught_error", "env_config", "constant", "unknown")


def features(f: Column) -> dict[str, Column]:
    """36 counters over the facts, and one for each origin of inputs."""
    shapes, read = F.flatten(f["conditions"]["shapes"]), F.array_distinct(operands(decisive(f)))
    count = lambda array, test: F.size(F.filter(array, test))
    same = lambda value: lambda x: x == value
    from_ = lambda origin: lambda o: o["provenance"] == origin
    most = lambda array: F.coalesce(F.array_max(array), F.lit(0))
    out = {"lines": f["lines"], "statements": f["statements"], "params": F.size(f["params"]), "conditions": F.size(f["conditions"]), "decisive_conditions": F.size(decisive(f)), "atoms": F.aggregate(f["conditions"]["atoms"], F.lit(0), lambda a, x: a + x)}
    out |= {f"cond_{s}": count(shapes, same(s)) for s in SHAPES}
    out |= {
        "string_literals": F.size(F.array_distinct(F.flatten(f["conditions"]["strings"]))),
        "numeric_literals": F.size(F.array_distinct(F.flatten(f["conditions"]["numbers"]))),
        "char_compares": count(f["conditions"], lambda c: c["char_compare"]),
        "arm_sets": F.size(f["arms"]),
        "max_arms": most(F.transform(f["arms"], lambda a: F.size(a["values"]))),
        "max_distinct_effects": most(F.transform(f["arms"], lambda a: F.size(F.array_distinct(a["effects"])))),
        "ternaries": f["ternaries"],
        "returns": F.size(f["returns"]),
        "literal_outcomes": F.size(literal_outcomes(f)),
        "jsx_returns": count(f["returns"], lambda r: r["kind"] == "jsx"),
        "calls": F.size(f["calls"]),
        **{c: f[c] for c in ("awaits", "throws", "loops", "arithmetic")},
        "conditional_accumulations": f["accumulations"],
        **{c: f[c] for c in ("weighted_terms", "selector_ops", "text_ops", "max_depth")},
        "closed_type_inputs": count(read, lambda o: o["closed"]),
        "textual_inputs": count(read, lambda o: o["textual"]),
        "numeric_inputs": count(read, lambda o: o["numeric"]),
    }
    return out | {f"input_{p}": count(read, from_(p)) for p in ORIGINS}
