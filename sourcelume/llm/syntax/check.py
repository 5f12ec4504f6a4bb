"""``first_error``: is a text valid for its language, and if not, where does it stop being so?"""

from __future__ import annotations

from functools import cache

from . import grammars, lexers
from .glr import Grammar, Recognizer

LANGUAGES = ("python", "javascript", "typescript", "tsx", "go", "java", "rust")


@cache
def _tools(lang: str) -> tuple[Recognizer, lexers.Lexer]:
    text = {
        "python": lambda: grammars.PYTHON,
        "javascript": lambda: grammars.ecma(False, False),
        "typescript": lambda: grammars.ecma(True, False),
        "tsx": lambda: grammars.ecma(True, True),
        "go": lambda: grammars.GO,
        "java": lambda: grammars.JAVA,
        "rust": lambda: grammars.RUST,
    }[lang]()
    script = lang in ("javascript", "typescript", "tsx")
    r = Recognizer(Grammar(text, "start"), newline=script, closers=("'}'", "END") if script else ())
    kind = {"python": lexers.Python, "javascript": lexers.Ecma, "typescript": lexers.Ecma, "tsx": lexers.Tsx, "go": lexers.Go, "java": lexers.Java, "rust": lexers.Rust}[lang]
    return r, kind(r.ids, r.error, r.newline)


def first_error(lang: str, text: str) -> int | None:
    """The line (from 1) of the first token that cannot continue any program of ``lang``; None if the text is one.

    The whole token stream is read. An unknown language raises ``KeyError``. Unlike a compiler, only syntax counts.
    """
    recognizer, lexer = _tools(lang)
    tokens = lexer.tokens(text)
    bad = recognizer.first_bad(tokens)
    if bad < 0:
        return None
    return text.count("\n") + 1 if bad >= len(tokens) else lexer.line_of(text, bad)
