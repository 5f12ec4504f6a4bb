"""Scalar functions on texts, spans and vectors, as Catalyst expressions where they can be."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lines(content: Column) -> Column:
    """The lines of a text: split at ``\\n``, trailing empty ones kept, one ``\\r`` before a line end dropped."""
    return F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, "\r\\z", ""))


def content_sha(content: Column) -> Column:
    """SHA-256 in hex; a null text counts as empty."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def byte_offset(line: Column, chars: Column) -> Column:
    """UTF-8 bytes before character ``chars`` (from 0) of ``line``."""
    return F.octet_length(F.substring(line, F.lit(1), chars))


def merge_spans(spans: Column) -> Column:
    """Half-open spans (arrays of two numbers) sorted, overlapping and touching ones united, empty ones dropped."""
    real = F.array_sort(F.filter(spans, lambda s: s[1] > s[0]))
    start = F.slice(real, 1, 1)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(done) > 0) & (s[0] <= last[1]), joined).otherwise(F.concat(done, F.array(s)))

    return F.when(F.size(real) == 0, real).otherwise(F.aggregate(F.slice(real, 2, F.greatest(F.size(real), F.lit(1))), start, step))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, of another length, holds a NaN or has no length."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & ~F.isnan(value), value)


def usable_vector(v: Column, dim: int) -> Column:
    good = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


#: Suffixes of source files and the language each stands for.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".rs": "rust"}


def language(path: Column) -> Column:
    """The language by a path's suffix, null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1)))


def glob_pattern(glob: str) -> str:
    """A case-sensitive shell pattern as a Java regular expression for the whole text."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end
        else:
            out.append("\\Q" + c + "\\E" if not c.isalnum() and c != "_" else c)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


#: Fixed value: an entry of a search vector in text form, the word quoted (quotes doubled), then its positions.
TS_ENTRY = r"'(?:[^']|'')+':[0-9]+[A-D]?(?:,[0-9]+[A-D]?)*"


def ts_entries(ts: Column) -> Column:
    """``array<struct<word, n>>`` of a search vector in text form: its words and how often each occurs. One pass of the
    pattern; an entry is then cut at its last colon."""

    def entry(e: Column) -> Column:
        places = F.substring_index(e, ":", -1)
        word = F.substring(e, F.lit(2), F.length(e) - F.length(places) - 3)
        return F.struct(F.lower(F.replace(word, F.lit("''"), F.lit("'"))).alias("word"), F.size(F.split(places, ",")).alias("n"))

    return F.transform(F.regexp_extract_all(ts, F.lit(TS_ENTRY), F.lit(0)), entry)
