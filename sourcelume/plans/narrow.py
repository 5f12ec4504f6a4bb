"""Which files can match a query, from a stored table of trigrams instead of contents.

A literal of three or more characters can only be in files that have all of its trigrams, a regular expression only where the
literals are that every match of it must hold. The lookup reads the few row groups of the table that its trigrams lie in; the
exact test then reads the contents of the candidates alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .language import And, Node, Not, Or, Term

#: Candidates up to which they are handed to the scan of files by id, where they prune row groups.
FEW = 1000


def trigrams(text: str) -> list[str]:
    """Distinct trigrams of a literal as the table has them: lower case."""
    t = text.lower()
    return sorted({t[i : i + 3] for i in range(len(t) - 2)})


def required_literals(pattern: str) -> list[str]:
    """Runs of characters that every match of a regular expression holds; none where that cannot be told."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []
    if parsed.state.flags & (re.VERBOSE | re.LOCALE):
        return []
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if len(run) > 2:
            out.append("".join(run))
        run.clear()

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                close()
                walk(arg[2])
                close()
            elif name != "AT":
                close()

    walk(parsed)
    close()
    return out


def _with_all(table: DataFrame, literals: list[str]) -> DataFrame | None:
    grams = sorted({g for x in literals for g in trigrams(x)})
    if not grams:
        return None
    hits = table.where(F.col("gram").isin(*grams)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(grams)).select("file_id")


def candidates(table: DataFrame, literal: str) -> DataFrame | None:
    """``(file_id)`` of files with all trigrams of ``literal``; None where it is too short to tell."""
    return _with_all(table, [literal])


def candidates_of(table: DataFrame, node: Node) -> DataFrame | None:
    """``(file_id)`` of the files that can match ``node``; None where any file can."""
    if isinstance(node, Not):
        return None
    if isinstance(node, Term):
        literals = [node.value] if node.kind == "substring" else required_literals(node.value) if node.kind == "regex" else []
        return _with_all(table, literals)
    parts = [candidates_of(table, c) for c in node.children]
    if isinstance(node, And):
        known = [p for p in parts if p is not None]
        return reduce(lambda a, b: a.join(b, "file_id", "left_semi"), known) if known else None
    assert isinstance(node, Or)
    return None if any(p is None for p in parts) else reduce(lambda a, b: a.unionByName(b), parts).distinct()


def narrowed(files: DataFrame, table: DataFrame, node: Node, key: str = "id") -> DataFrame:
    """``files`` without those that cannot match. Where few are left their ids go into the scan itself."""
    found = candidates_of(table, node)
    if found is None:
        return files
    ids = [r[0] for r in found.limit(FEW + 1).collect()]
    if len(ids) <= FEW:
        return files.where(F.col(key).isin(*ids)) if ids else files.where(F.lit(False))
    return files.join(found.withColumnRenamed("file_id", "__c"), files[key] == F.col("__c"), "left_semi")
