"""Credentials in source code, configuration and notes: found, and masked so that the code around them still parses.

A text is searched for string literals (pieces joined by ``+`` or juxtaposition count as one), unquoted values, URLs,
headers and key blocks. A value is a credential by its form (a private key, a signed token, a key id of a known form, login
data in a URL or header) or by its name together with its form (``db_pass = "..."``). Literals are decoded layer by layer
(escapes, percent, base64, hex; each encoded run inside a value, too, its lines joined if it is wrapped), key containers are
told from other data by their binary grammar (DER, OpenSSH), and what comes out is searched like the text outside; a hit
inside masks the literal that encloses it, or the run where it stands unquoted. Layers end where nothing decodes any more:
each is shorter than the one around it, and a string met again is not decoded again.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Hit(NamedTuple):
    line: int
    kind: str
    start: int
    end: int


#: Words in names whose values are secret, and words that make such a name harmless.
SECRET_NAME = re.compile(
    r"pass(?:word|wd|phrase|code)?(?![a-z])|passwd|password|passphrase|pwd|secret|(?<![a-z])token|token(?![a-z])|api[._-]?key|access[._-]?key|master[._-]?key|private[._-]?key|encryption[._-]?key|signing[._-]?key|account[._-]?key|shared[._-]?key"
    r"|(?<![a-z])auth(?![a-z])|auth[._-]?(?:header|token|key)|authorization|credential|(?<![a-z])creds?(?![a-z])|(?<![a-z])pem(?![a-z])|bearer|login",
    re.I,
)
_HARMLESS = re.compile(r"(?:field|label|hint|prompt|path|url|uri|kind|type|length|policy|min|max|public[_-]?key|file|ttl|expir\w*|endpoint|header[_-]?name|placeholder|regex|pattern)(?![a-z])", re.I)
_HASH_NAME = re.compile(r"sha(?:1|224|256|384|512)?(?![a-z])|md5|checksum|digest|integrity|fingerprint|commit|uuid|guid|revision|etag|public[_-]?key|icon|image|thumbprint", re.I)
_PLACEHOLDER = re.compile(r"\$\{|\{[A-Za-z_][\w.]*[}:!]|\$\(|\{\{|<[^<>]*>|^[*xX.•#?-]+$|%\(|^\$[A-Z_]+$|^(?:your|my|change|example|dummy|fake|test|sample|placeholder|todo|none|null|redacted|vault|env|secretref|ref)[-_:/.]|change-?me|redacted|placeholder|\bENC\[|process\.env|os\.environ|getenv", re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_PLAIN = re.compile(r"[a-z]+(?:[-_./: ][a-z]+)*$|[A-Z]+(?:[-_ ][A-Z]+)*$|[-+]?[0-9.,:_]+$|true$|false$|/[\w./-]*$|[a-z][\w-]*(?:\.[\w-]+)+(?::\d+)?(?:/[\w./-]*)?$|[a-z]+://[^@\s]*$|[A-Z][a-z]+$|[a-z]+[\[(].*", re.S)

PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PUTTY = re.compile(r"(PuTTY-User-Key-File-\d:(?:[^\n]*\n)+?Private-Lines:[ \t]*\d+[ \t]*\r?\n)((?:[A-Za-z0-9+/=]+[ \t]*(?:\r?\n|$))+)")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Published forms of keys and tokens that need no name.
FORMS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|[a-z]{2,8}_live_[A-Za-z0-9]{16,}|[a-z]{3,5}(?:\.|-)(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{24,64})(?![A-Za-z0-9+/=_])"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
URL = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://([^\s:/@\"'`<>]*):([^\s@\"'`<>]{3,}?)@(?=[\w\[-])")
HEADER = re.compile(r"\b(Bearer|Basic|Token)\s+([^\s\"'`,;)<>]{8,})")
_LITERAL = re.compile(r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_BARE = re.compile(r"[:=]>?[ \t]*(?=([^\s\"'`(){}\[\],<>=]{5,}[^\s\"'`(){}\[\],<>]*))")
_NAME = re.compile(r"[A-Za-z_][\w.-]*")
_CALL = re.compile(r"(?:login|log_in|sign_?in|auth\w*|dial|connect|credentials?|basic_?auth)\w*[^\n\w\"'`]*(?:\([^()\n]*\)[ \t]*=[ \t]*)?\(?[^()\n]*[\"'`][^\"'`\n]*[\"'`][ \t]*,[ \t]*$", re.I)
_PROSE = re.compile(r"\b(?:log(?:ged)? ?in|sign(?:ed)? ?in|password|passphrase|passwd|credentials?|secret|token|api key|access key)\b[^`\"'\n]{0,60}\b(?:with|is|was|using|to|as)\b[ \t:]*$", re.I)
_USER = re.compile(r"\s(?:-u|--user)[ =]+[\"']?([^\s:\"']+):([^\s\"'`]{4,})")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}$")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){8,}$")
#: Maximal encoded runs inside a value: either alphabet of base64, its parts in one alphabet, hex, and runs wrapped over lines.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}+={0,2}")
_PARTS = [re.compile(rf"[{a}]{{12,}}+={{0,2}}") for a in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]
_HEX_RUN = re.compile(r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{2}){8,}+(?![0-9a-fA-F])")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+(?:[ \t]*\r?\n[ \t]*(?:(?:#|//|\*|;|>)[ \t]+)?[A-Za-z0-9+/_-]++(?=={0,2}[ \t]*(?:\r?\n|\Z)))++={0,2}")
_LINE_RUN = re.compile(r"(?:^|(?<=\n))[ \t]*(?:(?:#|//|\*|;|>)[ \t]+)?([A-Za-z0-9+/_-]++={0,2})")


class _Memo:
    """A function of a text with its results so far, forgotten as a whole beyond ``room`` characters (no result depends on it)."""

    def __init__(self, f: Callable, room: int = 16_000_000):
        self.f, self.room, self.held = f, room, 0
        self.seen: dict = {}

    def __call__(self, text: str):
        if text in self.seen:
            return self.seen[text]
        out = self.f(text)
        if self.held > self.room:
            self.seen, self.held = {}, 0
        self.held += len(text) + 100
        self.seen[text] = out
        return out


def _entropy_like(v: str) -> bool:
    """Random-looking or password-shaped: of at least two character classes beyond lower-case words."""
    if len(v) < 6:
        return False
    digit, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    odd = any(not c.isalnum() and c not in "-_./: " for c in v)
    if len(v) >= 16 and " " not in v:
        return digit and (upper or lower) or upper and lower and not re.fullmatch(r"(?:[A-Z]?[a-z]++)++|[a-z]++(?:[A-Z][a-z]++)*+[A-Z]", v) or odd and (upper or lower)
    return (digit and odd and (upper or lower)) or (digit and upper and lower) or (len(v) >= 8 and odd and upper and lower and not v.endswith(("=", ":")))


def secret_value(v: str) -> bool:
    """May ``v`` be a secret, going by its form alone?"""
    v = v.strip()
    if _PLACEHOLDER.search(v) or _UUID.match(v) or _PLAIN.match(v) or v.startswith(("data:", "arn:")) or v.count(" ") > 1:
        return False
    u = URL.search(v)
    return _url_secret(u.group(2)) if u else _entropy_like(v)


#: Object identifiers (their octets) of password-based encryption and of PKCS#7 data.
PKCS5, PKCS12_PBE, PKCS7 = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"), bytes.fromhex("2a864886f70d0107")


def is_private_der(raw: bytes) -> bool:
    """A private key by its binary grammar: PKCS#1, PKCS#8 (encrypted, too), PKCS#12, DSA or SEC1 in DER, or an OpenSSH
    container; public keys are not."""
    if raw.startswith(b"openssh-key-v1\0"):
        return True

    def item(at: int) -> tuple[int, int, int] | None:
        if at + 2 > len(raw):
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if k == 0 or k > 4 or at + k > len(raw):
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        return (tag, at, at + n) if at + n <= len(raw) else None

    def items(at: int, end: int) -> list[tuple[int, int, int]] | None:
        out = []
        while at < end:
            x = item(at)
            if not x or x[2] > end:
                return None
            out.append(x)
            at = x[2]
        return out

    top = item(0)
    if not top or top[0] != 0x30:
        return False
    parts = items(top[1], top[2])
    if not parts:
        return False
    kinds = [k for k, _, _ in parts]
    if kinds == [0x30, 0x04]:  # encrypted: an algorithm, then the key as octets
        inner = items(parts[0][1], parts[0][2])
        oid = raw[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 0x06 else b""
        return oid.startswith((PKCS5, PKCS12_PBE))
    if kinds[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version = raw[parts[0][1]]
    pkcs1 = version in (0, 1) and len(kinds) >= 9 and all(k == 0x02 for k in kinds[:9])
    dsa = version == 0 and kinds == [0x02] * 6
    pkcs8 = version in (0, 1) and kinds[1:3] == [0x30, 0x04]
    sec1 = version == 1 and kinds[1:2] == [0x04]
    pkcs12 = version == 3 and kinds[1:2] == [0x30] and PKCS7 in raw[parts[1][1] : parts[1][1] + 16]
    return pkcs1 or dsa or pkcs8 or sec1 or pkcs12


def _unescape(v: str) -> str:
    def one(m):
        s = m.group()
        if s[1] in "xu":
            h = s[2:].strip("{}")
            return chr(int(h, 16)) if h and int(h, 16) < 0x110000 else s
        return {"n": "\n", "t": "\t", "r": "\r"}.get(s[1], s[1])

    return re.sub(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}|.)", one, v, flags=re.S)


def _runs(v: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of the encoded runs of ``v``, the lines of a wrapped one as one list; wrapped ones first, longer ones first."""
    for m in _WRAPPED.finditer(v):
        lines = [(m.start() + k.start(1), m.start() + k.end(1)) for k in _LINE_RUN.finditer(m.group())]
        yield lines
        i = 0
        while i < len(lines):  # lines of one length and a shorter last one
            n, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == n:
                j += 1
            j += j < len(lines) and lines[j][1] - lines[j][0] < n
            if 1 < j - i < len(lines):
                yield lines[i:j]
            i = j
    for m in _RUN.finditer(v):
        run, at = m.group(), m.start()
        for a, b in _telling(run):
            yield [(at + a, at + b)]


@_Memo
def _telling(run: str) -> tuple[tuple[int, int], ...]:
    """Spans of ``run`` and of its parts that decode to text or to a key container; of most names there are none."""
    spans = dict.fromkeys([(0, len(run)), *(k.span() for part in _PARTS for k in part.finditer(run)), *(k.span() for k in _HEX_RUN.finditer(run))])
    return tuple((a, b) for a, b in spans if any(len(text) >= 6 if text is not None else is_private_der(raw) for text, raw in _decoded(run[a:b])))


_ESCAPED_PERCENT = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")


def _unquoted(v: str) -> Iterator[tuple[str | None, bytes]]:
    if "\\" in v and (u := _unescape(v)) != v:
        yield u, u.encode("utf-8", "replace")
    # a percent sign that was escaped many times over is one layer
    if "%" in v and (u := unquote(_ESCAPED_PERCENT.sub("%", v))) != v:
        yield u, u.encode("utf-8", "replace")


def _decoded(s: str) -> Iterator[tuple[str | None, bytes]]:
    if _HEX.match(s):
        raw = binascii.unhexlify(s)
        yield _text(raw), raw
    elif _B64.match(s):
        try:
            raw = base64.b64decode(s.replace("-", "+").replace("_", "/").rstrip("=") + "=" * (-len(s.rstrip("=")) % 4))
        except (binascii.Error, ValueError):
            return
        yield _text(raw), raw


def layers(v: str) -> Iterator[tuple[str | None, bytes]]:
    """What one layer of encoding around ``v``, or around a run inside it, hides: (text or None, bytes)."""
    yield from _unquoted(v)
    seen = {whole := "".join(v.split())}
    yield from _decoded(whole)
    for spans in _runs(v):
        s = "".join(v[a:b] for a, b in spans)
        if s not in seen:
            seen.add(s)
            yield from _decoded(s)


def _text(raw: bytes) -> str | None:
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return t if t and sum(c.isprintable() or c in "\r\n\t" for c in t) == len(t) else None


@_Memo
def by_form(v: str) -> str | None:
    """The kind of credential that ``v`` is or encodes, whatever its name; None if none."""
    if (p := PRIVATE.search(v)) and not _masked(v[p.end() :]):
        return "private_key"
    if (m := FORMS.search(v)) and not _PLACEHOLDER.search(v):
        return "jwt" if m.group().startswith("eyJ") else "key_form"
    for m in URL.finditer(v):
        if _url_secret(m.group(2)):
            return "url"
    m = HEADER.search(v)
    if m and _header_secret(m.group(1), m.group(2)):
        return "header"
    for text, raw in layers(v):
        if k := _hidden(text, raw):
            return k
    return None


def _hidden(text: str | None, raw: bytes) -> str | None:
    """The kind of credential in what a layer hides, searched like a text of its own."""
    if text is None:
        return "encoded_private_key" if is_private_der(raw) else None
    return _inside(text) if len(text) >= 6 else None


@_Memo
def _inside(text: str) -> str | None:
    k = by_form(text) or _named_inside(text) or next((h.kind for h in find(text)), None)
    return "encoded_" + k.removeprefix("encoded_") if k else None


@_Memo
def _encoded_run(s: str) -> str | None:
    return next((k for text, raw in _decoded(s) if (k := _hidden(text, raw))), None)


_BOUND_TO = re.compile(r"[\"']?([A-Za-z_][\w.\-]*)[\"']?(?:\s*\|\||\s*\?\?|\s+or\b)?\s*(?::\s*[^=:]*)?(?:=|:|:=|=>|\|\||\?\?|\bor\b)\s*(?:[bfru&]|str\()?\s*$")
_ARGUMENT_OF = re.compile(r"([A-Za-z_][\w.\-]*)\s*(?::\s*[^=]*)?(?::=|=|:)\s*[\w.&*]*\(?\s*$")


def _masked(body: str) -> bool:
    """Whether no key follows a BEGIN mark: nothing at all, or what ``redact`` leaves."""
    return not re.search(r"[^xX.…\s\\n\"'`+,;#*/]", PRIVATE_END.split(body)[0])


def _named_inside(text: str) -> str | None:
    for m in _BARE.finditer(text):
        if secret_value(m.group(1)) and name_is_secret(_bound(text, m.start())):
            return "named"
    marks = Marks(text)
    for m in _LITERAL.finditer(text):
        if secret_value(m.group()[1:-1]) and name_is_secret(marks.name_before(m.start())):
            return "named"
    return None


def _url_secret(p: str) -> bool:
    return not (set(p) <= set("xX*") or _PLACEHOLDER.search(p) or re.fullmatch(r"\{[^{}]*\}|%[sdv]|\$\w+|password|passwd|pass|pwd|secret|token|user", p, re.I))


def _header_secret(scheme: str, v: str) -> bool:
    if _PLACEHOLDER.search(v) or re.fullmatch(r"[{$%].*", v):
        return False
    if scheme == "Basic":
        for text, _ in (*_unquoted(v), *_decoded(v)):
            if text and ":" in text and not _PLACEHOLDER.search(text.split(":", 1)[1]):
                return True
        return False
    return secret_value(v) or by_form(v) is not None


def name_is_secret(name: str) -> bool:
    # camel case becomes words, so that "pass" is found in "dbPassNasa" and not in "passive"
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    if not SECRET_NAME.search(words) or _HASH_NAME.search(words):
        return False
    tail = _HARMLESS.search(words)
    return not (tail and tail.start() > SECRET_NAME.search(words).start())


class Marks:
    """Where lines, statements and arguments of a text begin, so that what stands before a place is found without reading
    back through a line, however long it is."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self._parts: list[int] | None = None

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def line_start(self, at: int) -> int:
        k = bisect_left(self.lines, at)
        return self.lines[k - 1] + 1 if k else 0

    def _split(self) -> None:
        if self._parts is None:
            found = [(m.start(), m.group()) for m in re.finditer(r"[\n,;({]", self.text)]
            self._parts = [i for i, _ in found]
            self._calls = [i for i, c in found if c != ","]

    def part_start(self, at: int) -> int:
        """The begin of the argument or statement that ``at`` stands in."""
        self._split()
        k = bisect_left(self._parts, at)
        return self._parts[k - 1] + 1 if k else 0

    def call_start(self, at: int) -> int:
        """The begin of the statement, or of the call with its name, whose few arguments ``at`` is one of."""
        self._split()
        k = bisect_left(self._calls, at)
        start = self._calls[k - 1] if k else -1
        if bisect_left(self._parts, at) - bisect_right(self._parts, start) > 4:
            return at
        # the bracket of the call, and one of a type between it and the name
        for j in range(k - 1, max(k - 3, -1), -1):
            if self.text[start] != "(":
                break
            start = self._calls[j - 1] if j else -1
            if start < 0:
                break
        return start + 1

    def name_before(self, at: int) -> str:
        """The name a literal is bound to: the last one before it, after the nearest separator."""
        m = _BOUND_TO.findall(self.text[self.part_start(at) : at])
        if m:
            return m[-1]
        m = _ARGUMENT_OF.search(self.text[self.call_start(at) : at])
        return m.group(1) if m else ""


def find(text: str) -> list[Hit]:
    """Every credential of ``text``, under any number of layers of encoding, with its line (from 1) and the span to mask, in
    order; spans do not overlap."""
    out: list[Hit] = []
    starts: list[int] = []  # of the spans to mask, in order, and their ends
    ends: list[int] = []
    marks = Marks(text)

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not k or ends[k - 1] <= s

    def add(at: int, kind: str, s: int, e: int) -> None:
        if s < e and free(s, e):
            k = bisect_left(starts, s)
            starts.insert(k, s)
            ends.insert(k, e)
            out.append(Hit(marks.line(at), kind, s, e))

    for m in PRIVATE.finditer(text):
        end = PRIVATE_END.search(text, m.end())
        nxt = PRIVATE.search(text, m.end())
        stop = end.start() if end and not (nxt and nxt.start() < end.start()) else re.compile(r"(?:[ \t]*(?:#|//|\*)?[ \t\"']*[A-Za-z0-9+/=\\]+[\"',+ \t]*\r?(?:\n|$))*").match(text, m.end()).end()
        if _masked(text[m.end() : stop]):
            continue
        add(m.start(), "private_key", m.end(), max(stop, m.end() + 1) if stop > m.end() else min(len(text), m.end() + 1))
    for m in PUTTY.finditer(text):
        if not _masked(m.group(2)):
            add(m.start(), "private_key", *m.span(2))
    lits = [m for m in _LITERAL.finditer(text)]
    i = 0
    while i < len(lits):
        m = lits[i]
        q = 3 if m.group()[:3] in ('"""', "'''") else 1
        pieces = [(m.start() + q, m.end() - q)]
        while i + 1 < len(lits) and lits[i + 1].group()[:1] in "\"'`" and "\n" not in (gap := text[lits[i].end() : lits[i + 1].start()]) and re.fullmatch(r"[ \t]*[+.]?[ \t]*", gap) and (gap.strip() or text[lits[i].end() - 1] != ":"):
            i += 1
            k = lits[i]
            pieces.append((k.start() + 1, k.end() - 1))
        i += 1
        v = "".join(text[a:b] for a, b in pieces)
        if len(v) < 6:
            continue
        kind = by_form(v)
        if kind is None and secret_value(v):
            name = marks.name_before(m.start())
            if name_is_secret(name):
                kind = "named"
            elif _PROSE.search(text, max(marks.line_start(m.start()), m.start() - 160), m.start()):
                kind = "prose"
            elif not _HASH_NAME.search(name) and _CALL.search(text, marks.call_start(m.start()), m.start()):
                kind = "login"
        if kind:
            if kind == "url" and len(pieces) == 1:
                a, b = pieces[0]
                for u in URL.finditer(text, a, b):
                    if _url_secret(u.group(2)):
                        add(m.start(), kind, *u.span(2))
            else:
                hit_line_at = m.start()
                if kind.startswith("encoded_") and "\n" in v:
                    inside_of = ([(a + m.start(), b + m.start()) for a, b in r] for r in _runs(m.group()))
                    hit_line_at = next((r[0][0] for r in inside_of if _encoded_run("".join(text[a:b] for a, b in r))), m.start())
                if kind == "private_key":
                    p = PRIVATE.search(text, pieces[0][0], pieces[-1][1])
                    hit_line_at = p.start() if p else hit_line_at
                    if p and not free(p.end(), p.end() + 1):
                        continue
                for a, b in pieces:
                    add(hit_line_at, kind, a, b)
    inside = sorted((m.start(), m.end()) for m in lits)

    def quoted(at: int) -> bool:
        lo, hi = 0, len(inside)
        while lo < hi:
            mid = (lo + hi) // 2
            if inside[mid][1] <= at:
                lo = mid + 1
            else:
                hi = mid
        return lo < len(inside) and inside[lo][0] <= at

    for m in FORMS.finditer(text):
        if free(*m.span()) and not _HASH_NAME.search(_bound(text, m.start())) and not _PLACEHOLDER.search(m.group()):
            add(m.start(), "jwt" if m.group().startswith("eyJ") else "key_form", *m.span())
    for m in URL.finditer(text):
        if _url_secret(m.group(2)) and "\n" not in m.group():
            add(m.start(), "url", *m.span(2))
    for m in HEADER.finditer(text):
        if _header_secret(m.group(1), m.group(2)):
            add(m.start(), "header", *m.span(2))
    for m in _USER.finditer(text):
        if secret_value(m.group(2)):
            add(m.start(2), "login", *m.span(2))
    for spans in _runs(text):
        if not quoted(spans[0][0]) and (k := _encoded_run("".join(text[a:b] for a, b in spans))):
            for a, b in spans:
                add(spans[0][0], k, a, b)
    for m in _BARE.finditer(text):
        v = m.group(1).rstrip(";.")
        if v.isdigit() or v.isalpha() and (len(v) < 16 or v.islower()) or quoted(m.start(1)):
            continue
        if secret_value(v) and not re.search(r"[\w\])]\(|\)$|=>|&&|\|\||->", v) and _bare_ok(v) and name_is_secret(_bound(text, m.start())):
            add(m.start(1), "named", m.start(1), m.start(1) + len(v))
        elif len(v) >= 12 and (k := by_form(v)) and not _HASH_NAME.search(_bound(text, m.start())):
            add(m.start(1), k, m.start(1), m.start(1) + len(v))
    return sorted(out, key=lambda h: h.start)


def _bound(text: str, at: int) -> str:
    """The name before an assignment sign."""
    while at and text[at - 1] in " \t=:>":
        at -= 1
    end = at - (at > 0 and text[at - 1] in "\"'")
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
        start -= 1
    m = _NAME.search(text, start, end)
    return m.group() if m else ""


def _bare_ok(v: str) -> bool:
    """Unquoted values are secrets in configuration, notes and comments; in code they are mostly expressions, that is names
    made of words."""
    if not re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", v):
        return True
    if re.fullmatch(r"[0-9a-f]{24,}|[0-9A-F]{24,}", v):
        return True
    upper, lower = sum(c.isupper() for c in v), sum(c.islower() for c in v)
    if len(v) < 16 or upper < 3 or lower < 3:
        return False
    return bool(re.search(r"\d", v)) and len(v) >= 20 or not re.fullmatch(r"[A-Z]?[a-z0-9]*(?:_?[A-Z]{1,2}[a-z0-9]{2,})*_*", v)


def redact(text: str) -> tuple[str, list[Hit]]:
    """``text`` with every credential masked: as many ``x``, line breaks kept, so places and quoting stay as they are."""
    hits = find(text)
    if not hits:
        return text, hits
    parts, at = [], 0
    for h in hits:
        parts += [text[at : h.start], re.sub(r"[^\r\n]", "x", text[h.start : h.end])]
        at = h.end
    return "".join([*parts, text[at:]]), hits


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lines, kinds = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = set()
            for h in find(t):
                if (h.line, h.kind) not in seen:
                    seen.add((h.line, h.kind))
                    ids.append(i)
                    lines.append(h.line)
                    kinds.append(h.kind)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=["id", "line_no", "kind"])


def credential_lines(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``(id, line_no, kind)``: the lines that hold credentials; a private key counts on the line of its BEGIN mark.

    Null and empty contents hold none. Rows that repeat come out as often as they came in.
    """
    return files.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("id"), content).mapInArrow(_scan, "id long, line_no int, kind string")


def redacted(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``files`` with ``content`` masked and ``masked``, the number of masked spans (0 where the content is null)."""
    schema = "__t string, __n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, 0) if t is None else (lambda r: (r[0], len(r[1])))(redact(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=[*b.schema.names[:-1], "__t", "__n"])

    rest = [c for c in files.columns if c != content and c != "masked"]
    rows = files.select(*rest, content)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, {schema}" if kept else schema).withColumnsRenamed({"__t": content, "__n": "masked"})
