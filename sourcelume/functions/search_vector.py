"""Search vectors of texts: words with their places, English stop words left out, the rest cut down to stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: English words that are not indexed.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these"
    " those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after"
    " above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s"
    " t can will just don should now".split()
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_VOWEL, _PAIR, _LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
#: Stems that rules would get wrong, and words that are their own.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _after(w: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel, from ``start``."""
    for i in range(start + 1, len(w)):
        if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
            return i + 1
    return len(w)


def _short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-1] not in _VOWEL + "wxY" and w[-2] in _VOWEL and w[-3] not in _VOWEL


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """The stem of a lower-case English word (the second version of Porter's algorithm); other words stay as they are."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w[0] == "y":
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), 0)
    r1 = head or _after(w, 0)
    r2 = _after(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past and progressive forms
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end in ("eedly", "eed"):
                w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
            elif any(c in _VOWEL for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_PAIR):
                    w = w[:-1]
                elif len(w) <= r1 and _short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # suffixes of suffixes
    end = next((e for e in sorted(_STEP2, key=len, reverse=True) if w.endswith(e)), None)
    if end:
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + _STEP2[end]
    elif w.endswith("ogi"):
        w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in set(_LI):
        w = w[:-2]
    end = next((e for e in sorted(_STEP3, key=len, reverse=True) if w.endswith(e)), None)
    if end:
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + _STEP3[end]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    end = next((e for e in _STEP4 if w.endswith(e)), None)
    if end:
        w = w[: -len(end)] if len(w) - len(end) >= r2 else w
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def words(text: str) -> list[tuple[str, int]]:
    """(stem, place) of the words of a text that are no stop words; places count from 1, stop words as well."""
    out = []
    for n, w in enumerate(_WORD.findall(text.lower()), 1):
        base = re.split("['’]", w)[0]
        if base not in STOP:
            out.append((stem(base), n))
    return out


def vector_text(text: str) -> str:
    """A search vector in text form: ``'word':1,7 'other':3``, words in order."""
    at: dict[str, list[int]] = {}
    for w, n in words(text):
        at.setdefault(w, []).append(n)
    return " ".join(f"'{w}':{','.join(map(str, at[w]))}" for w in sorted(at))


def search_vector(content: Column) -> Column:
    """The search vector of every text, null for a null one."""

    def make(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else vector_text(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(make, "string")(content)
