"""Lexers: a text becomes token ids of a recognizer.

One regular expression per language splits a text into lexemes in C; a table remembers the ids of each lexeme seen, so a
lexeme is classified once. Unlexable text gives the error token, which no grammar takes.
"""

from __future__ import annotations

import re
from itertools import chain

from . import grammars

_SPACE = r"[ \t\f\v﻿ ​]*"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*\.?(?:[eE][+-]?[0-9_]+)?)"
NAME_START = re.compile(r"[^\W\d]|[$_]")


class Lexemes(dict):
    """Ids of a lexeme, computed when first seen."""

    def __init__(self, classify, room: int = 400_000):
        super().__init__()
        self.classify, self.room = classify, room

    def __missing__(self, lexeme: str) -> tuple[int, ...]:
        ids = self.classify(lexeme)
        if len(self) < self.room:
            self[lexeme] = ids
        return ids


class Lexer:
    """Common part: ``split`` finds lexemes, ``classify`` gives their ids. Subclasses hold a language's own rules."""

    pattern: re.Pattern
    words: frozenset[str] = frozenset()
    assign: frozenset[str] = frozenset()

    def __init__(self, ids: dict[str, int], error: int, newline: int):
        self.ids, self.error, self.newline = ids, error, newline
        self.seen = Lexemes(self.classify)
        self.words = frozenset(t[1:-1] for t in ids if t[0] == "'" and (t[1].isalpha() or t[1] == "_") and t != "'_'") | ({"_"} if "'_'" in ids else set())

    def tok(self, *names: str) -> tuple[int, ...]:
        return tuple(self.ids.get(n, self.error) for n in names)

    def lexemes(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def tokens(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.seen.__getitem__, self.lexemes(text))))

    def line_of(self, text: str, index: int) -> int:
        """The line (from 1) of token ``index``; counts again, as only rejected texts need it."""
        n, at = 0, 0
        for m in self.pattern.finditer(text):
            n += len(self.seen[m.group(1) if m.re.groups else m.group()])
            if n > index:
                return text.count("\n", 0, m.start(1) if m.re.groups else m.start()) + 1
            at = m.end()
        return text.count("\n", 0, at) + 1

    def symbol(self, s: str) -> tuple[int, ...]:
        if s in self.assign:
            return self.tok("AOP")
        return self.tok(f"'{s}'")

    def name(self, s: str) -> tuple[int, ...]:
        if s in self.words:
            return self.tok(f"'{s}'")
        return self.tok("NAME") if NAME_START.match(s) else (self.error,)

    def classify(self, s: str) -> tuple[int, ...]:
        raise NotImplementedError


def _number(s: str, pattern: re.Pattern) -> bool:
    return pattern.fullmatch(s) is not None


class Python(Lexer):
    assign = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
    _plain = r"(?<![^\W_])[rRbBuU]{0,2}"
    _formatted = r"(?:[fFtT][rR]?|[rR][fFtT])"
    _triple = r'(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\')'
    _hole = r"\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})*\}"
    _str = (
        r"(?:" + _formatted + _triple + r"|" + _formatted + r'(?:"(?!"")(?:[^"\\\n{]|\\[\s\S]|' + _hole + r")*\"|'(?!'')(?:[^'\\\n{]|\\[\s\S]|" + _hole + r")*')"
        r"|" + _plain + r"(?:" + _triple + r'|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|\'(?!\'\')(?:[^\'\\\n]|\\[\s\S])*\'))'
    )
    pattern = re.compile(
        r"(?:[ \t\f]|\\\r?\n)*((?:(?:#[^\n]*)?\r?\n[ \t\f]*)+|#[^\n]*\Z|" + _str + r"|[^\W\d]\w*|\.?[0-9](?:[eE][+-]|[\w.])*"
        r"|\*\*=?|//=?|>>=?|<<=?|->|:=|\.\.\.|[-+*/%@&|^=!<>]=|[^\s\\])"
    )
    number = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?[0-9])*))|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?)[jJ]?")
    plain_zero = re.compile(r"0[0-9_]*[1-9][0-9_]*")

    def __init__(self, ids, error, newline):
        super().__init__(ids, error, newline)
        self.nl, self.indent, self.dedent = ids["NL"], ids["INDENT"], ids["DEDENT"]

    def classify(self, s):
        c = s[0]
        if "\n" in s and (c in "#\r\n \t"):
            return (-1, len(s))
        if c == "#":
            return ()
        if s[-1] in "\"'" and len(s) > 1:
            return self.tok("STR")
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return self.tok("NUM") if self.number.fullmatch(s) and not self.plain_zero.fullmatch(s) else (self.error,)
        if c.isalpha() or c == "_" or ord(c) > 127:
            return self.name(s)
        return self.symbol(s)

    def tokens(self, text):
        if text[:1] == "﻿":
            text = text[1:]
        out: list[int] = []
        add, seen = out.append, self.seen
        opens, closes = {self.ids[f"'{c}'"] for c in "([{"}, {self.ids[f"'{c}'"] for c in ")]}"}
        depth, levels = 0, [0]
        lead = re.match(r"[ \t\f]*(?=[^\s#\\])", text)
        if lead and lead.group():
            add(self.indent)
            levels.append(len(lead.group().expandtabs(8)))
        started = False
        for s in self.pattern.findall(text):
            for t in (-1,) if "\n" in s and s[0] in "#\r\n \t" else seen[s]:
                if t == -1:
                    if depth:
                        continue
                    col = len(s[s.rindex("\n") + 1 :].replace("\f", "").expandtabs(8))
                    if started:
                        add(self.nl)
                    if col != levels[-1]:
                        self._level(col, levels, out, started)
                    started = started
                    continue
                started = True
                if t in opens:
                    depth += 1
                elif t in closes:
                    depth = max(0, depth - 1)
                add(t)
        # white space before the end of the text opens no block
        while out and out[-1] in (self.indent, self.dedent):
            out.pop()
            levels = levels[:1]
        base = sum((t == self.indent) - (t == self.dedent) for t in out)
        if out and out[-1] != self.nl:
            add(self.nl)
        out.extend([self.dedent] * max(0, base))
        return out

    def _level(self, col, levels, out, started):
        if col > levels[-1]:
            levels.append(col)
            out.append(self.indent)
            return
        while levels and levels[-1] > col:
            levels.pop()
            out.append(self.dedent)
        if not levels or levels[-1] != col:
            out.append(self.error)
            levels.append(col)

    def line_of(self, text, index):
        out_at = 0
        # tokens are laid out in text order; find how much text gives as many tokens
        lo, hi = 0, text.count("\n") + 1
        lines = text.split("\n")
        while lo < hi:
            mid = (lo + hi) // 2
            out_at = len([t for t in self.tokens("\n".join(lines[: mid + 1])) if t not in (self.nl, self.indent, self.dedent)])
            want = len([t for t in self.tokens(text)[: index + 1] if t not in (self.nl, self.indent, self.dedent)])
            if out_at >= want:
                hi = mid
            else:
                lo = mid + 1
        return lo + 1


class Ecma(Lexer):
    assign = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()) | {"="}
    _inner = r"(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}`]|\{[^{}`]*\})*\})*"
    _tpl = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{" + _inner + r"\})*`"
    _regex = r"/(?![/*])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\])+/[A-Za-z]*"
    _gap = r"(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/)*"
    pattern = re.compile(
        r"[ \t\f\v﻿ ]*((?:\r?\n[ \t]*)+|//[^\n\r]*|/\*[\s\S]*?\*/|(?:[(,=:\[!&|?{;~+*%<>^-]|\b(?:return|typeof|case|in|of|do|else|void|delete|instanceof|new|throw|yield|await)\b|=>)" + _gap + _regex
        + r"|\A" + _gap + _regex + r"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|" + _tpl + r"|#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4})*"
        r"|\.?[0-9](?:[eE][+-]?(?=[0-9])|[\w.])*|\?\.(?![0-9])|\.\.\.|=>|={3}|!==|\*\*=?|<<=?|>+=|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%&|^=!<>]=|\S)"
    )
    number = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)")
    inner = re.compile(_regex)
    hole = re.compile(r"\$\{(" + _inner + r")\}|\\[\s\S]")

    def classify(self, s):
        c = s[0]
        if c in "\r\n":
            return (self.newline,)
        if c == "/" and s[1:2] in ("/", "*") and len(s) > 1:
            return (self.newline,) if "\n" in s else ()
        if c in "'\"":
            return self.tok("STR") if len(s) > 1 else (self.error,)
        if c == "`":
            if len(s) == 1:
                return (self.error,)
            holes = [m.group(1) for m in self.hole.finditer(s) if m.group(1) is not None]
            if not holes:
                return self.tok("TPL")
            out = list(self.tok("TPLOPEN"))
            for i, h in enumerate(holes):
                if i:
                    out += self.tok("TPLSEP")
                out += [t for t in self.tokens(h) if t != self.newline]
            return (*out, *self.tok("TPLCLOSE"))
        if len(s) > 2 and not s.startswith(("...", "===")):
            m = None
            for m in self.inner.finditer(s):
                pass
            if m and m.end() == len(s) and (c in "(,=:[!&|?{;~+*%<>^-/ \n" or c.isalpha()) and m.start() >= 0 and (m.start() == 0 or not (c.isalpha() and m.start() < 2)):
                head = s[: self._cut(s)].strip()
                return (*chain.from_iterable(self.seen[x] for x in self.pattern.findall(head)), *self.tok("REGEX"))
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return self.tok("NUM") if self.number.fullmatch(s) else (self.error,)
        if c == "#":
            return self.tok("PRIV") if len(s) > 1 else (self.error,)
        if c.isalpha() or c in "$_\\" or ord(c) > 127:
            if "\\" in s:
                return self.tok("NAME")
            return self.name(s)
        return self.symbol(s)

    def _cut(self, s: str) -> int:
        """Where the regular expression that ends the lexeme ``s`` begins: after the first symbol or word and the gap."""
        m = re.match(r"(?:=>|[(,=:\[!&|?{;~+*%<>^-]|[a-z]+)?" + self._gap, s)
        return m.end()

    def symbol(self, s):
        if s[0] == ">" and len(s) > 1 and s[-1] == "=" and s != ">=":
            return self.tok("AOP")
        if s == "=":
            return self.tok("'='")
        return super().symbol(s)

    def tokens(self, text):
        if text.startswith("#!"):
            text = "//" + text
        ids = super().tokens(text)
        inc, nl = self.ids["'++'"], self.newline
        dec = self.ids["'--'"]
        if inc in ids or dec in ids:  # after a line break these are prefixes
            pre = self.ids["PREINC"]
            for i in range(1, len(ids)):
                if (ids[i] == inc or ids[i] == dec) and ids[i - 1] == nl:
                    ids[i] = pre
        return ids


class Tsx(Ecma):
    """TypeScript with elements: inside tags and between them other rules hold, kept on a stack."""

    tag = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
    attr = re.compile(r"\s*(?:(/\s*>)|(>)|(\{)|(=)|(\"[^\"]*\"|'[^']*')|([A-Za-z_$][\w$:-]*)|(/\*[\s\S]*?\*/|//[^\n]*)|(.))", re.S)
    close = re.compile(r"<\s*/\s*([A-Za-z_$][\w$.:-]*)?\s*>")
    text_part = re.compile(r"[^<{]+")

    def tokens(self, text):
        if "<" not in text:
            return super().tokens(text)
        out: list[int] = []
        t = lambda n: self.ids[n]
        stack: list = []  # ("js", depth) inside braces, ("tag", name), ("child", name)
        operand_end = {t(x) for x in ("NAME", "NUM", "STR", "TPL", "TPLCLOSE", "REGEX", "')'", "']'", "'}'", "'this'", "'super'", "'null'", "'true'", "'false'", "JSELF", "JCLOSE")} | {t(f"'{w}'") for w in grammars.TS_WORDS if f"'{w}'" in self.ids}
        i, n, prev = 0, len(text), -1
        while i < n:
            mode = stack[-1][0] if stack else "js"
            if mode == "js":
                m = self.pattern.search(text, i)
                if not m:
                    break
                s = m.group(1)
                at = m.start(1)
                if s == "<" and prev not in operand_end and re.match(r"<\s*(?:[A-Za-z_$]|>)", text[at : at + 40]) and not re.match(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b|=[^>]*>\s*\()", text[at : at + 60]):
                    g = self.tag.match(text, at)
                    out.append(t("JOPEN"))
                    stack.append(("tag", g.group(1) or ""))
                    i = g.end()
                    prev = out[-1]
                    continue
                if len(s) > 1 and s[0] in "({[,?:=&|" and "<" in s and "/" in s:  # not a regular expression but tags
                    if re.match(r"[({\[,?:=&|>]+\s*<", s):
                        s = s[0]
                        m = None
                if s == "{":
                    stack.append(("js", ""))
                elif s == "}" and stack:
                    stack.pop()
                    if stack and stack[-1][0] != "js":
                        out.append(t("JR"))
                        i = m.end(1)
                        prev = out[-1]
                        continue
                out.extend(self.seen[s])
                if out and out[-1] != self.newline:
                    prev = out[-1]
                i = m.end(1) if m else at + 1
            elif mode == "tag":
                m = self.attr.match(text, i)
                if not m:
                    break
                i = m.end()
                if m.group(1):
                    out.append(t("JSELF"))
                    stack.pop()
                elif m.group(2):
                    out.append(t("JGT"))
                    stack[-1] = ("child", stack[-1][1])
                elif m.group(3):
                    out.append(t("JL"))
                    stack.append(("js", ""))
                elif m.group(4):
                    out.append(t("'='"))
                elif m.group(5):
                    out.append(t("JSTR"))
                elif m.group(6):
                    out.append(t("JNAME"))
                elif not m.group(7):
                    out.append(self.error)
                    break
                prev = out[-1]
            else:
                c = text[i]
                if c == "{":
                    out.append(t("JL"))
                    stack.append(("js", ""))
                    i += 1
                elif c == "<":
                    m = self.close.match(text, i)
                    if m:
                        out.append(t("JCLOSE") if (m.group(1) or "") == stack[-1][1] else self.error)
                        stack.pop()
                        i = m.end()
                    else:
                        g = self.tag.match(text, i)
                        out.append(t("JOPEN"))
                        stack.append(("tag", g.group(1) or ""))
                        i = g.end()
                else:
                    m = self.text_part.match(text, i)
                    out.append(self.error if ">" in m.group() or "}" in m.group() else t("JTEXT"))
                    i = m.end()
                prev = out[-1]
        return out

    def line_of(self, text, index):
        lo, hi = 0, text.count("\n")
        lines = text.split("\n")
        while lo < hi:
            mid = (lo + hi) // 2
            if len(self.tokens("\n".join(lines[: mid + 1]))) > index:
                hi = mid
            else:
                lo = mid + 1
        return lo + 1


class Go(Lexer):
    assign = frozenset("+= -= *= /= %= &= |= ^= <<= >>= &^=".split())
    pattern = re.compile(
        r"[ \t\f\v﻿]*((?:\r?\n\s*)+|//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))'|[^\W\d]\w*|\.?[0-9](?:[eEpP][+-]|[\w.])*"
        r"|&\^=?|<<=?|>>=?|<-|&&|\|\||\+\+|--|:=|\.\.\.|[-+*/%&|^=!<>]=|\S)"
    )
    number = re.compile(r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO]?[0-7_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*\.?(?:[eE][+-]?[0-9_]+)?)i?")

    def __init__(self, ids, error, newline):
        super().__init__(ids, error, newline)
        self.line = -1
        self.ends = {ids[x] for x in ("NAME", "NUM", "STR", "CHAR", "'break'", "'continue'", "'fallthrough'", "'return'", "'++'", "'--'", "')'", "']'", "'}'")}

    def classify(self, s):
        c = s[0]
        if c in "\r\n":
            return (-1,)
        if s[:2] == "//":
            return ()
        if s[:2] == "/*":
            return (-1,) if "\n" in s else ()
        if c in "\"`":
            return self.tok("STR") if len(s) > 1 else (self.error,)
        if c == "'":
            return self.tok("CHAR") if len(s) > 1 else (self.error,)
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return self.tok("NUM") if self.number.fullmatch(s) else (self.error,)
        if c.isalpha() or c == "_" or ord(c) > 127:
            return self.name(s)
        return self.symbol(s)

    def tokens(self, text):
        semi, ends = self.ids["';'"], self.ends
        out: list[int] = []
        prev = -1
        for t in chain.from_iterable(map(self.seen.__getitem__, self.lexemes(text))):
            if t == -1:
                if prev in ends:
                    out.append(semi)
                    prev = semi
            else:
                out.append(t)
                prev = t
        if prev in ends:
            out.append(semi)
        return out

    def line_of(self, text, index):
        lo, hi = 0, text.count("\n")
        lines = text.split("\n")
        while lo < hi:
            mid = (lo + hi) // 2
            if len(self.tokens("\n".join(lines[: mid + 1]))) > index:
                hi = mid
            else:
                lo = mid + 1
        return lo + 1


class Java(Lexer):
    assign = frozenset("+= -= *= /= %= &= |= ^= <<= >>= >>>=".split())
    pattern = re.compile(
        r"[ \t\f\r\n﻿]*(//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n\r]|\\[^\n\r])*\"|'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n\r]))'|non-sealed\b"
        r"|(?:[^\W\d]|\$)[\w$]*|\.?[0-9](?:[eEpP][+-](?=[0-9])|[\w.])*|\.\.\.|->|::|<<=?|>+=|&&|\|\||\+\+|--|[-+*/%&|^=!<>]=|\S)"
    )
    number = re.compile(r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*\.?(?:[eE][+-]?[0-9_]+)?[lLfFdD]?)")
    #: Java's primitive types, and the words that are literals.
    prims = frozenset("boolean byte short int long char float double".split())
    lits = frozenset("true false null".split())
    #: Reserved words that no production uses.
    unused = frozenset("const goto".split())

    def classify(self, s):
        c = s[0]
        if c in " \t\f\r\n﻿" or s[:2] in ("//", "/*") and len(s) > 1:
            return ()
        if c == '"' or c == "'":
            return self.tok("STR") if len(s) > 1 else (self.error,)
        if s == "non-sealed":
            return self.tok("NONSEALED")
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return self.tok("NUM") if self.number.fullmatch(s) else (self.error,)
        if c.isalpha() or c in "$_" or ord(c) > 127:
            if s in self.prims:
                return self.tok("PRIM")
            if s in self.lits:
                return self.tok("LIT")
            return (self.error,) if s in self.unused or s == "_" else self.name(s)
        if c == ">" and s[-1] == "=" and s != ">=":
            return self.tok("AOP")
        return self.symbol(s)


class Rust(Lexer):
    assign = frozenset("+= -= *= /= %= &= |= ^= <<= >>=".split())
    _c0 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/"
    _c1 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|" + _c0 + r")*\*/"
    _c2 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|" + _c1 + r")*\*/"
    pattern = re.compile(
        r"[ \t\f\r\n﻿]*(//[^\n]*|" + _c2 + r"|[bc]?r\"[^\"]*\"|[bc]?r#\"[\s\S]*?\"#|[bc]?r##\"[\s\S]*?\"##|[bc]?r###\"[\s\S]*?\"###|[bc]?\"(?:[^\"\\]|\\[\s\S])*\""
        r"|b?'(?:[^'\\\n\r]|\\(?:u\{[0-9a-fA-F_]{1,8}\}|x[0-9a-fA-F]{2}|.))'|'[^\W\d]\w*|r#[^\W\d]\w*|[^\W\d]\w*|[0-9](?:\.[0-9]+(?!\w*\.\.)|\.(?![.\w])|[eE][+-](?=[0-9])|\w)*"
        r"|\.\.=|\.\.\.?|->|=>|::|<<=|>>=|<<|&&|\|\||[-+*/%&|^=!<>]=|\S)"
    )
    number = re.compile(r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.(?:[0-9][0-9_]*)?)?(?:[eE][+-]?[0-9_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?")
    #: Reserved words that no production uses.
    unused = frozenset("abstract become do final macro override priv typeof unsized virtual try".split())

    def classify(self, s):
        c = s[0]
        if c in " \t\f\r\n﻿" or s[:2] in ("//", "/*") and len(s) > 1:
            return ()
        if s[-1] == '"' and len(s) > 1 or s[-1] == "#" and '"' in s:
            return self.tok("STR")
        if c == "'" or s[:2] == "b'":
            if len(s) > 2 and s[-1] == "'":
                return self.tok("CHAR")
            return self.tok("LIFE") if len(s) > 1 else (self.error,)
        if c.isdigit():
            return self.tok("LITNUM") if self.number.fullmatch(s) else (self.error,)
        if s[:2] == "r#":
            return self.tok("NAME")
        if c.isalpha() or c == "_" or ord(c) > 127:
            return (self.error,) if s in self.unused else self.name(s)
        return self.symbol(s)
