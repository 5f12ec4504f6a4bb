"""Source files that do not parse, per file, and their rates per repository and language.

Every text is lexed whole and its token stream run through the table-driven recognizer of its language (``syntax``). The
tables come from grammars bundled as text and are built lazily, once in a Python worker; nothing is broadcast and rows do
not move: the scan's own splits are the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .syntax import LANGUAGES, first_error


def _error_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *kept, lang, text = b.columns
        lines = [first_error(x, t) if t.strip() else None for x, t in zip(lang.to_pylist(), text.to_pylist())]
        yield pa.RecordBatch.from_arrays([*kept, lang, pa.array(lines, pa.int32())], names=[*b.schema.names[:-1], "error_line"])


def parse_errors(files: DataFrame, keep: list[str], lang: str = "lang", content: str = "content") -> DataFrame:
    """``keep``, ``lang`` and ``error_line``, the line (from 1) where a text stops being a program of its language, for
    every row whose language is known; null for texts that parse.

    Rows with a null content, or a language that is null or not one of ``LANGUAGES``, are left out. A content that is
    empty or white space counts as valid in every language. Rows that repeat come out as often as they came in.
    """
    keep = [c for c in keep if c != lang]
    rows = files.where(F.col(lang).isin(*LANGUAGES) & F.col(content).isNotNull()).select(*keep, lang, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", error_line int"
    return rows.mapInArrow(_error_lines, schema)


def error_rates(errors: DataFrame, *by: str) -> DataFrame:
    """``files``, ``invalid`` and ``rate`` for each value of ``by``; null values form a group of their own."""
    return (
        errors.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("files"), F.count("error_line").alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
