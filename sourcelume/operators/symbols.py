"""Symbol definitions that answer a query's ``sym:`` terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.corpus import Corpus, contains, select_files
from ..plans.language import Node, affirmative, case_of, parse


def symbol_patterns(node: Node) -> list[str]:
    return [t.value for t in affirmative(node, "sym")]


def find_symbols(corpus: Corpus, query: str | Node, files: DataFrame | None = None) -> DataFrame | None:
    """Definitions in the files a query selects whose name holds any of its ``sym:`` values; None if it has none.

    The terms narrow files together, but a definition need match one only. The owning file's ``repo_id`` counts.
    """
    node = parse(query) if isinstance(query, str) else query
    patterns = symbol_patterns(node)
    if not patterns:
        return None
    sensitive = case_of(query) if isinstance(query, str) else any(t.case for t in affirmative(node, "substring", "regex"))
    files = select_files(corpus, node, sensitive) if files is None else files
    named = reduce(lambda a, b: a | b, [contains(F.col("name"), p, sensitive) for p in patterns])
    s = corpus.symbols.where(named).select(F.col("id").alias("symbol_id"), "file_id", "name", "kind", "start_line", "end_line")
    f = files.select(F.col("id").alias("file_id"), "repo_id", "repo_name", "path", "content_sha", "lang", "branches")
    return s.join(f, "file_id")


SYMBOL_ORDER = ("repo_id", "path", "content_sha", "start_line", "name", "symbol_id")


def ordered_symbols(symbols: DataFrame, limit: int) -> DataFrame:
    return symbols.orderBy(*[F.asc_nulls_last(c) for c in SYMBOL_ORDER]).limit(limit)
