"""Symbols and call or import references of a source file, by scanning its tokens.

Comments and strings are set aside first. Definitions are recognized by their keywords and get their extent from braces, or
in Python from indentation; a reference belongs to the innermost named definition around it. Contract: names, kinds,
targets and lines as listed in the tests. Shapes that need a full parser are not looked for (anonymous functions bound to
names, macros).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Symbol(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int


class Edge(NamedTuple):
    kind: str
    target: str
    line: int
    enclosing: Symbol | None


class Tok(NamedTuple):
    kind: str  # name, str, num, op, nl
    text: str
    line: int
    at: int


_STRINGS = {
    "python": r"[rbuftRBUFT]{0,3}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')",
    "go": r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'",
    "rust": r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{\w+\}|x\w\w|.))'|'\w+",
    "java": r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "ecma": r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[(,=:\[!&|?;{}\n])[ \t]*/(?![/*])(?:[^\\/\[\n]|\\.|\[(?:\\.|[^\]\\\n])*\])+/[a-z]*",
}
_COMMENTS = {"python": r"#[^\n]*", "ecma": r"//[^\n]*|/\*[\s\S]*?\*/", "go": r"//[^\n]*|/\*[\s\S]*?\*/", "java": r"//[^\n]*|/\*[\s\S]*?\*/", "rust": r"//[^\n]*|/\*[\s\S]*?\*/"}
_RULES = {"javascript": "ecma", "typescript": "ecma", "tsx": "ecma"}
_TOKENS = {
    k: re.compile(rf"(?P<comment>{_COMMENTS[k]})|(?P<str>{s})|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>=>|->|::|\?\.|\.\.\.|[^\s\w])", re.S) for k, s in _STRINGS.items()
}
#: Words that can stand before a parenthesis without being called.
_NOT_CALLED = {
    "python": set("and as assert async await class def del elif else except finally for from if import in is lambda nonlocal not or pass raise return try while with yield match case print".split()) - {"print", "match", "case"},
    "ecma": set("if for while switch catch function return typeof void delete new in of instanceof do else case throw yield await super import class extends const let var".split()),
    "go": set("if for switch select func return go defer range case type struct interface map chan import package var const else".split()),
    "java": set("if for while switch catch return synchronized try new throw else case assert super this do instanceof".split()),
    "rust": set("if while for match return fn loop in as let move unsafe pub use mod impl where else struct enum trait type ref mut crate".split()),
}


_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|//[^\n]*|/\*[\s\S]*?\*/")


def template(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of the template string that begins at ``at``, and the spans of the expressions in it; those may hold further
    strings and templates."""
    parts, i = [], at + 1
    while i < len(text) and text[i] != "`":
        if text.startswith("${", i):
            begin = i = i + 2
            depth = 1
            while i < len(text):
                c = text[i]
                if c == "`":
                    i = template(text, i)[0]
                    continue
                if c in "\"'/" and (m := _QUOTED.match(text, i)):
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                if not depth:
                    break
                i += 1
            parts.append((begin, i))
        i += 2 if text[i : i + 1] == "\\" else 1
    return min(i + 1, len(text)), parts


def tokens(text: str, rules: str, start: int = 0, stop: int | None = None, line: int = 1) -> list[Tok]:
    """Tokens of ``text[start:stop]``, whose first line is ``line``; comments are left out."""
    out: list[Tok] = []
    pattern, at = _TOKENS[rules], start
    stop = len(text) if stop is None else stop
    nested = rules == "ecma" and text.find("`", start, stop) >= 0  # only templates end elsewhere than their pattern does
    while at < stop:
        again = None
        for m in pattern.finditer(text, at, stop):
            s, kind = m.group(), m.lastgroup
            if kind == "nl":
                out.append(Tok(kind, s, line, m.start()))
                line += 1
            elif kind == "comment":
                line += s.count("\n")
            elif m.group("str") is None:
                out.append(Tok(kind, s, line, m.start()))
                if nested and s == "`":  # a template that does not end
                    return out
            else:
                lead = len(s) - len(s.lstrip())
                begin, end = m.start() + lead, m.end()
                line += s.count("\n", 0, lead)
                if nested and text[begin] == "`":
                    end = min(template(text, begin)[0], stop)
                    again = end if end != m.end() else None
                out.append(Tok("str", text[begin:end], line, begin))
                line += text.count("\n", begin, end)
                if again is not None:
                    break
        if again is None:
            break
        at = again
    return out


def _close(ts: list[Tok], i: int, opening: str = "{", closing: str = "}") -> int:
    """Index of the token that closes ``ts[i]``, or of the last token."""
    depth = 0
    for k in range(i, len(ts)):
        if ts[k].text == opening and ts[k].kind == "op":
            depth += 1
        elif ts[k].text == closing and ts[k].kind == "op":
            depth -= 1
            if depth == 0:
                return k
    return len(ts) - 1


def _next(ts: list[Tok], i: int, stop: str, until: str = ";") -> int:
    """Index of the next ``stop`` outside parentheses, -1 if ``until`` or the end comes first."""
    depth = 0
    for k in range(i, len(ts)):
        t = ts[k]
        if t.kind != "op":
            continue
        if t.text in "([":
            depth += 1
        elif t.text in ")]":
            depth -= 1
        elif depth == 0 and t.text == stop:
            return k
        elif depth == 0 and t.text in (until, "}"):
            return -1
    return -1


class _File:
    """Collects definitions with their token ranges and references with their places."""

    def __init__(self):
        self.defs: list[tuple[int, int, Symbol]] = []
        self.refs: list[tuple[int, str, str, int]] = []

    def define(self, first: Tok, last: Tok, start: int, end: int, name: str, kind: str) -> None:
        self.defs.append((start, end, Symbol(name, kind, first.line, last.line)))

    def result(self) -> tuple[list[Symbol], list[Edge]]:
        self.defs.sort(key=lambda d: (d[0], -d[1]))
        edges, open_defs, n = [], [], 0
        for at, kind, target, line in sorted(self.refs, key=lambda r: r[0]):
            while n < len(self.defs) and self.defs[n][0] <= at:
                open_defs.append(self.defs[n])
                n += 1
            while open_defs and open_defs[-1][1] < at:
                open_defs.pop()
            edges.append(Edge(kind, target, line, open_defs[-1][2] if open_defs else None))
        return [d[2] for d in self.defs], edges


def _signatures(ts: list[Tok], i: int) -> set[int]:
    """The names in an interface body that begins after ``ts[i]`` which stand for methods, not calls."""
    b = _next(ts, i, "{")
    out, depth = set(), 0
    for k in range(b, _close(ts, b)) if b > 0 else ():
        depth += {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}.get(ts[k].text, 0) if ts[k].kind == "op" else 0
        if depth == 1 and ts[k].kind == "name":
            out.add(k)
    return out


def _calls(ts: list[Tok], f: _File, rules: str, skip: set[int]) -> None:
    code = [i for i, t in enumerate(ts) if t.kind != "nl"]
    for n, i in enumerate(code):
        t = ts[i]
        if t.kind != "name" or i in skip or t.text in _NOT_CALLED[rules]:
            continue
        k = n + 1
        if rules in ("ecma", "rust", "java") and k < len(code) and ts[code[k]].text in ("<", "::"):
            j = k + (ts[code[k]].text == "::")
            if j < len(code) and ts[code[j]].text == "<" and (rules != "java" or n and ts[code[n - 1]].text in ("new", ".", "::")):
                depth, j0 = 0, j
                while j < len(code) and j - j0 < 60:
                    depth += {"<": 1, ">": -1}.get(ts[code[j]].text, 0)
                    j += 1
                    if depth == 0 or ts[code[j - 1]].text in (";", "{"):
                        break
                k = j if depth == 0 else k
        if k < len(code) and ts[code[k]].text == "?." and rules == "ecma":
            k += 1
        before = ts[code[n - 1]].text if n else ""
        if rules in ("ecma", "java"):
            # a constructor counts by the last name of its path, called or not
            path = n
            while path >= 2 and ts[code[path - 1]].text == "." and ts[code[path - 2]].kind == "name":
                path -= 2
            if path >= 1 and ts[code[path - 1]].text == "new":
                if k < len(code) and ts[code[k]].text != ".":
                    f.refs.append((t.at, "call", t.text, ts[code[path - 1]].line))
                continue
        if k < len(code) and ts[code[k]].text == "(" and ts[code[k]].kind == "op" and before not in ("def", "class", "function", "fn", "func"):
            if rules == "rust" and before == "!":
                continue
            start = n
            while start >= 2 and ts[code[start - 1]].text in (".", "::", "?.") and ts[code[start - 2]].kind == "name":
                start -= 2
            f.refs.append((t.at, "call", t.text, ts[code[start]].line))


def _python(text: str) -> _File:
    f, ts = _File(), tokens(text, "python")
    skip: set[int] = set()
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    depth, fresh = 0, True
    inside = set()  # lines that continue a bracket or string
    for t in ts:
        if t.kind == "op" and t.text in "([{":
            depth += 1
        elif t.kind == "op" and t.text in ")]}":
            depth = max(0, depth - 1)
        if t.kind == "str":
            inside.update(range(t.line + 1, t.line + 1 + t.text.count("\n")))
        if t.kind == "nl" and depth:
            inside.add(t.line + 1)
    code_lines = sorted({t.line for t in ts if t.kind != "nl"})
    indent = lambda n: len(lines[n - 1].expandtabs(8)) - len(lines[n - 1].expandtabs(8).lstrip())
    last_of = {}
    for t in ts:
        if t.kind != "nl":
            last_of[t.line] = max(last_of.get(t.line, 0), t.line + t.text.count("\n"))
    i = 0
    while i < len(ts):
        t = ts[i]
        if fresh and t.kind == "name":
            j = i + 1 if t.text == "async" and i + 1 < len(ts) and ts[i + 1].text == "def" else i
            if ts[j].text in ("def", "class") and j + 1 < len(ts) and ts[j + 1].kind == "name":
                own = indent(t.line)
                end = t.line
                header = next((ts[k].line for k in range(j, len(ts)) if ts[k].kind == "op" and ts[k].text == ":"), t.line)
                for c in range(bisect_right(code_lines, t.line), len(code_lines)):
                    n = code_lines[c]
                    if n in inside or n <= header or indent(n) > own:
                        end = max(end, last_of[n])
                    else:
                        break
                f.define(t, Tok("", "", max(end, last_of.get(t.line, t.line)), 0), t.at, starts[min(max(end, t.line), len(lines))] - 1, ts[j + 1].text, "function" if ts[j].text == "def" else "class")
                skip.add(j + 1)
            elif t.text in ("import", "from"):
                stop = i
                d = 0
                while stop < len(ts) and not (ts[stop].kind == "nl" and d == 0) and ts[stop].text != ";":
                    d += {"(": 1, ")": -1}.get(ts[stop].text, 0) if ts[stop].kind == "op" else 0
                    stop += 1
                _python_import([x for x in ts[i:stop] if x.kind != "nl"], f)
                skip.update(range(i, stop))
                i = stop
                continue
        fresh = t.kind == "nl" and (t.line + 1) not in inside or (fresh and t.kind == "nl") or (t.kind == "op" and t.text in ";:")
        i += 1
    _calls(ts, f, "python", skip)
    return f


def _python_import(ts: list[Tok], f: _File) -> None:
    def dotted(k: int) -> tuple[str, int]:
        s = ""
        while k < len(ts) and (ts[k].text in (".", "...") or ts[k].kind == "name" and ts[k].text not in ("import", "as")):
            s += ts[k].text
            k += 1
        return s, k

    if ts[0].text == "import":
        k = 1
        while k < len(ts):
            line = ts[k].line
            name, k = dotted(k)
            if name:
                f.refs.append((ts[0].at + k, "import", name, line))
            while k < len(ts) and ts[k].text != ",":
                k += 1
            k += 1
        return
    module, k = dotted(1)
    if k >= len(ts) or ts[k].text != "import":
        return
    join = module if module.endswith(".") else module + "."
    k += 1
    while k < len(ts):
        t = ts[k]
        if t.text == "*":
            f.refs.append((t.at, "import", module, t.line))
        elif t.text == "as":
            k += 1
        elif t.kind == "name":
            f.refs.append((t.at, "import", join + t.text, t.line))
        k += 1


def _unquote(s: str) -> str:
    return s.strip("\"'`")


def _ecma(text: str) -> _File:
    f, ts = _File(), [t for t in tokens(text, "ecma") if t.kind != "nl"]
    skip: set[int] = set()
    bodies: list[tuple[int, int]] = []
    i = 0
    while i < len(ts):
        t, nxt = ts[i], ts[i + 1] if i + 1 < len(ts) else None
        if t.kind == "name" and t.text == "function" and nxt and (nxt.kind == "name" or nxt.text == "*" and i + 2 < len(ts) and ts[i + 2].kind == "name"):
            k = i + 1 + (nxt.text == "*")
            b = _next(ts, k, "{")
            skip.add(k)
            first = ts[i - 1] if i and ts[i - 1].text == "async" else t
            if b > 0:
                e = _close(ts, b)
                f.define(first, ts[e], first.at, ts[e].at, ts[k].text, "function")
        elif t.kind == "name" and t.text == "class" and nxt and nxt.kind == "name" and (not i or ts[i - 1].text != "."):
            b = _next(ts, i + 1, "{")
            if b > 0:
                e = _close(ts, b)
                first = ts[i - 1] if i and ts[i - 1].text == "abstract" else t
                f.define(first, ts[e], first.at, ts[e].at, nxt.text, "class")
                bodies.append((b, e))
        elif t.kind == "name" and t.text == "interface" and nxt and nxt.kind == "name":
            skip |= _signatures(ts, i + 2)
        elif t.kind == "name" and t.text == "import" and nxt and nxt.text not in ("(", ".") and (not i or ts[i - 1].text in (";", "}", ")") or ts[i - 1].line < t.line or ts[i - 1].kind == "str"):
            i = _ecma_import(ts, i, f, skip)
            continue
        i += 1
    for b, e in bodies:
        k = b + 1
        while k < e:
            t = ts[k]
            if t.kind in ("name", "str") and k + 1 < e and (ts[k + 1].text == "(" or ts[k + 1].text == "<") and t.text not in _NOT_CALLED["ecma"]:
                o = _next(ts, k + 1, "{")
                p = k + 1
                while p < e and ts[p].text != "(":
                    p += 1
                q = _close(ts, p, "(", ")")
                if 0 < o < e and q < o and all(x.text not in ("=", ";") for x in ts[q + 1 : o]):
                    c = _close(ts, o)
                    first = k
                    while first - 1 > b and ts[first - 1].text in ("static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override"):
                        first -= 1
                    f.define(ts[first], ts[c], ts[first].at, ts[c].at, _unquote(t.text), "method")
                    skip.add(k)
                    k = c
            elif t.text in "([{" and t.kind == "op":
                k = _close(ts, k, t.text, {"(": ")", "[": "]", "{": "}"}[t.text])
            k += 1
    _calls(ts, f, "ecma", skip)
    _in_templates(text, ts, f)
    return f


def _in_templates(text: str, ts: list[Tok], f: _File) -> None:
    """The calls in the expressions of template strings."""
    for t in ts:
        if t.kind == "str" and t.text.startswith("`") and "${" in t.text:
            for a, b in template(text, t.at)[1]:
                inner = [x for x in tokens(text, "ecma", a, b, t.line + text.count("\n", t.at, a)) if x.kind != "nl"]
                _calls(inner, f, "ecma", set())
                _in_templates(text, inner, f)


def _ecma_import(ts: list[Tok], i: int, f: _File, skip: set[int]) -> int:
    k = i + 1
    names: list[Tok] = []
    plain: list[Tok] = []
    while k < len(ts) and ts[k].kind != "str" and ts[k].text != ";":
        if ts[k].text == "{":
            e = _close(ts, k)
            p = k + 1
            while p < e:
                if ts[p].text == "type" and p + 1 < e and ts[p + 1].kind == "name" and ts[p + 1].text != "as":
                    p += 1
                names.append(ts[p])
                while p < e and ts[p].text != ",":
                    p += 1
                p += 1
            k = e
        elif ts[k].kind == "name" and ts[k].text not in ("from", "as", "type", "require"):
            plain.append(ts[k])
        elif ts[k].text == "type" and k + 1 < len(ts) and ts[k + 1].text == "from":
            plain.append(ts[k])
        elif ts[k].text == "*":
            plain.append(ts[k])
        k += 1
    skip.update(range(i, k + 1))
    if k < len(ts) and ts[k].kind == "str":
        module = _unquote(ts[k].text)
        if plain or not names:
            f.refs.append((ts[i].at, "import", module, ts[i].line))
        for t in names:
            f.refs.append((t.at, "import", f"{module}.{_unquote(t.text)}", t.line))
        return k + 1
    return k


def _go(text: str) -> _File:
    f = _File()
    ts = [t for t in tokens(text, "go") if t.kind != "nl"]
    skip: set[int] = set()
    for i, t in enumerate(ts):
        nxt = ts[i + 1] if i + 1 < len(ts) else None
        if t.text == "interface" and nxt and nxt.text == "{":
            skip |= _signatures(ts, i + 1)
        if t.text == "func" and t.kind == "name" and nxt:
            k, kind = i + 1, "function"
            if nxt.text == "(":
                k, kind = _close(ts, i + 1, "(", ")") + 1, "method"
            if k < len(ts) and ts[k].kind == "name" and (kind == "function" or k + 1 < len(ts) and ts[k + 1].text == "("):
                p = k + 1
                while p < len(ts) and ts[p].text != "(":
                    p += 1
                q = _close(ts, p, "(", ")") + 1
                while q < len(ts) and ts[q].text != "{" and ts[q].line == ts[q - 1].line:
                    q = _close(ts, q, "(", ")") + 1 if ts[q].text == "(" else _close(ts, q + 1) + 1 if ts[q].text in ("interface", "struct") else q + 1
                body = q < len(ts) and ts[q].text == "{" and ts[q].line == ts[q - 1].line
                e = _close(ts, q) if body else q - 1
                f.define(t, ts[e], t.at, ts[e].at, ts[k].text, kind)
                skip.add(k)
        elif t.text == "type" and t.kind == "name" and nxt and (not i or ts[i - 1].text not in (".", "(")):
            group = nxt.text == "("
            k, stop = (i + 2, _close(ts, i + 1, "(", ")")) if group else (i + 1, len(ts))
            while k < stop and ts[k].kind == "name":
                e = k + 1
                while e < stop and ts[e].line == ts[e - 1].line:
                    e = _close(ts, e, ts[e].text, {"{": "}", "(": ")", "[": "]"}[ts[e].text]) + 1 if ts[e].text in "{([" and ts[e].kind == "op" else e + 1
                f.define(ts[k], ts[e - 1], ts[k].at, ts[e - 1].at, ts[k].text, "type")
                k = e
                if not group:
                    break
        elif t.text == "import" and t.kind == "name" and nxt:
            specs = ts[i + 2 : _close(ts, i + 1, "(", ")")] if nxt.text == "(" else ts[i + 1 : i + 3]
            for s in specs:
                if s.kind == "str":
                    line = next((x.line for x in specs if x.line == s.line), s.line)
                    f.refs.append((s.at, "import", _unquote(s.text), line))
                    if nxt.text != "(":
                        break
    _calls(ts, f, "go", skip)
    return f


def _java(text: str) -> _File:
    f, ts = _File(), [t for t in tokens(text, "java") if t.kind != "nl"]
    skip: set[int] = set()
    for i, t in enumerate(ts):
        nxt = ts[i + 1] if i + 1 < len(ts) else None
        if t.kind != "name":
            continue
        if t.text in ("class", "interface") and nxt and nxt.kind == "name" and (not i or ts[i - 1].text not in (".", "@")):
            b = _next(ts, i + 1, "{")
            if b > 0:
                first = _java_start(ts, i)
                e = _close(ts, b)
                f.define(ts[first], ts[e], ts[first].at, ts[e].at, nxt.text, t.text)
                skip.add(i + 1)
        elif t.text == "import" and nxt and (not i or ts[i - 1].text == ";"):
            e = i + 1
            while e < len(ts) and ts[e].text != ";":
                e += 1
            target = "".join(x.text for x in ts[i + 1 : e] if x.text != "static").removesuffix(".*")
            f.refs.append((t.at, "import", target, t.line))
            skip.update(range(i, e))
        elif nxt and nxt.text == "(" and i and (ts[i - 1].kind == "name" and ts[i - 1].text not in _NOT_CALLED["java"] or ts[i - 1].text in (">", "]") and not _typed_call(ts, i - 1)) and t.text not in _NOT_CALLED["java"]:
            q = _close(ts, i + 1, "(", ")") + 1
            if q < len(ts) and ts[q].text == "throws":
                while q < len(ts) and ts[q].text not in ("{", ";"):
                    q += 1
            if q < len(ts) and ts[q].text in ("{", ";") and (ts[q].text == "{" or ts[i - 1].text != "new"):
                e = _close(ts, q) if ts[q].text == "{" else q
                first = _java_start(ts, i - 1)
                f.define(ts[first], ts[e], ts[first].at, ts[e].at, t.text, "method")
                skip.add(i)
    _calls(ts, f, "java", skip)
    return f


def _typed_call(ts: list[Tok], i: int) -> bool:
    """Whether the ``>`` at ``i`` closes the type arguments of a call, ``obj.<T>m()``."""
    depth = 0
    while i >= 0 and ts[i].text not in (";", "{", "}"):
        depth += {">": 1, "<": -1}.get(ts[i].text, 0)
        if depth == 0:
            return i > 0 and ts[i - 1].text == "."
        i -= 1
    return False


def _java_start(ts: list[Tok], i: int) -> int:
    """The first token of the declaration around token ``i``: after the last ``;``, brace, or unopened parenthesis."""
    depth = 0
    while i > 0:
        x = ts[i - 1].text
        if ts[i - 1].kind == "op":
            if x in (";", "{", "}") and depth == 0:
                break
            depth += {")": 1, "(": -1}.get(x, 0)
            if depth < 0:
                break
        i -= 1
    return i


def _rust(text: str) -> _File:
    f, ts = _File(), [t for t in tokens(text, "rust") if t.kind != "nl"]
    skip: set[int] = set()
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait"}
    for i, t in enumerate(ts):
        nxt = ts[i + 1] if i + 1 < len(ts) else None
        if t.kind != "name":
            continue
        if t.text in kinds and nxt and nxt.kind == "name":
            b = _next(ts, i + 1, "{")
            semi = next((k for k in range(i + 1, len(ts)) if ts[k].text == ";" and ts[k].kind == "op"), len(ts) - 1)
            e = _close(ts, b) if b > 0 else semi
            if t.text == "fn" and b < 0:
                skip.add(i + 1)
                continue
            first = i
            while first and (ts[first - 1].text in ("pub", "async", "const", "unsafe", "extern", "default") or ts[first - 1].text == ")" and first > 3 and ts[first - 4].text == "pub"):
                first -= 4 if ts[first - 1].text == ")" else 1
            f.define(ts[first], ts[e], ts[first].at, ts[e].at, nxt.text, kinds[t.text])
            skip.add(i + 1)
        elif t.text == "use" and (not i or ts[i - 1].text in (";", "}", "{", "pub", ")", "]")):
            e = i + 1
            while e < len(ts) and ts[e].text != ";":
                e += 1
            _rust_use(ts[i + 1 : e], "", f)
            skip.update(range(i, e))
    _calls(ts, f, "rust", skip)
    return f


def _rust_use(ts: list[Tok], prefix: str, f: _File) -> None:
    """One use tree; a group's parts follow the path before it."""
    path: list[str] = []
    k = 0
    while k < len(ts):
        t = ts[k]
        if t.text == "{":
            e = _close(ts, k)
            start = k + 1
            depth = 0
            for p in range(k + 1, e + 1):
                depth += {"{": 1, "}": -1}.get(ts[p].text, 0)
                if (ts[p].text == "," and depth == 0) or p == e:
                    if ts[start:p]:
                        _rust_use(ts[start:p], "::".join(x for x in [prefix, *path] if x), f)
                    start = p + 1
            return
        if t.text == "as":
            break
        if t.kind == "name":
            path.append(t.text)
        k += 1
    if path[-1:] == ["self"] and prefix:
        path.pop()
    target = "::".join(x for x in [prefix, *path] if x)
    if target and ts:
        f.refs.append((ts[0].at, "import", target, ts[0].line))


_SCANNERS = {"python": _python, "ecma": _ecma, "go": _go, "java": _java, "rust": _rust}


def extract(lang: str | None, text: str | None) -> tuple[list[Symbol], list[Edge]]:
    """Symbols in order of their start, and references in order of their place; nothing for unknown languages."""
    scanner = _SCANNERS.get(_RULES.get(lang or "", lang or ""))
    return scanner(text).result() if scanner and text else ([], [])


_SCHEMA = (
    "id long, symbols array<struct<name:string,kind:string,start_line:int,end_line:int>>,"
    " edges array<struct<edge_kind:string,target_name:string,line:int,enclosing_name:string,enclosing_kind:string,enclosing_start_line:int,enclosing_end_line:int>>"
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sym = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
    names = ("edge_kind", "target_name", "line", "enclosing_name", "enclosing_kind", "enclosing_start_line", "enclosing_end_line")
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    for b in batches:
        ss, es = [], []
        for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            s, e = extract(lang, text)
            ss.append([x._asdict() for x in s])
            es.append([dict(zip(names, (x.kind, x.target, x.line, *(x.enclosing or (None,) * 4)))) for x in e])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ss, sym), pa.array(es, pa.list_(pa.struct(list(zip(names, kinds)))))], names=["id", "symbols", "edges"])


def extract_files(files: DataFrame) -> DataFrame:
    """``(id, symbols, edges)`` of every row with a known language and a content."""
    rows = files.where(F.col("lang").isNotNull() & F.col("content").isNotNull()).select(F.col("id").cast("long").alias("id"), "lang", "content")
    return rows.mapInArrow(_run, _SCHEMA)


def symbols_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("id").alias("file_id"), F.inline("symbols"))


def edges_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("id").alias("file_id"), F.inline("edges"))
