"""Patterns as the store understands them, for Java's engine; and for the line-level rescan in Python."""

from __future__ import annotations

import re

#: POSIX classes and word-boundary escapes that Java spells differently.
_POSIX = {
    "alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}",
    "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}",
}
_WORD_ENDS = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "A": r"\A", "Z": r"\z", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}
_PIECE = re.compile(r"\\(.)|(\[\[:<:\]\])|(\[\[:>:\]\])|\[:(\w+):\]|(\[\^?\]?)|(\])|(\$)|(.)", re.S)


class BadPattern(ValueError):
    """The pattern is not valid."""


def to_java(pattern: str, sensitive: bool, whole: bool = True) -> str:
    """``pattern`` for ``rlike``. ``whole``: ``^`` and ``$`` stand for the ends of the whole text and ``.`` takes line ends
    too, as in the store; otherwise they are those of a line."""
    out, inside = [], False
    for m in _PIECE.finditer(pattern):
        esc, start, end, posix, opened, closed, dollar, other = m.groups()
        if esc is not None:
            out.append(_WORD_ENDS[esc] if not inside and esc in _WORD_ENDS else m.group())
        elif start or end:
            out.append(r"\b(?=\w)" if start else r"\b(?<=\w)")
        elif posix is not None:
            if not inside or posix not in _POSIX:
                if not inside:
                    out.append("[:" + posix + ":]")
                    continue
                raise BadPattern(f"unknown character class [:{posix}:]")
            out.append(_POSIX[posix])
        elif opened is not None:
            if inside:
                out.append("\\[" + opened[1:].replace("]", "\\]"))
            else:
                inside = True
                out.append(opened.replace("]", "\\]"))
        elif closed is not None:
            inside = False
            out.append("]")
        elif dollar is not None:
            out.append("\\$" if inside else r"\z" if whole else "$")
        else:
            out.append("\\&\\&" if inside and other == "&" and out and out[-1] == "&" else other)
    if inside:
        raise BadPattern("unterminated character class")
    flags = ("s" if whole else "m") + ("" if sensitive else "iu")
    return f"(?{flags})" + "".join(out)


def max_width(pattern: str) -> int:
    """The longest text ``pattern`` can match; 0 for patterns that match only empty texts, 1 or more if unknown."""
    try:
        from re import _parser as p  # the standard library's own analysis
    except ImportError:  # pragma: no cover
        return 1
    try:
        return int(p.parse(pattern).getwidth()[1])
    except Exception:
        return 1
