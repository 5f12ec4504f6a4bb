"""The relations a query runs over, and the lowering of an expression tree to Catalyst.

A tree becomes one Boolean column over ``files`` and a few equi-joins that feed it: repositories by their id, symbols by
file, branch heads by repository. Nothing is collected. A ``sym:`` that every result must have becomes a semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small
from ..sources.tables import table
from .language import And, Node, Not, Or, Term, names_branches, walk
from .narrow import narrowed
from .regex_dialect import to_java

HEAD = "HEAD"


@dataclass(frozen=True)
class Corpus:
    repos: DataFrame
    files: DataFrame
    symbols: DataFrame
    reference_edges: DataFrame
    repo_branches: DataFrame
    chunks: DataFrame
    #: Stored indexes, where there are any: ``(gram, file_id)``, and ``(word, chunk_id, n, len)``.
    grams: DataFrame | None = None
    postings: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Corpus:
        return cls(*(table(spark, root, n) for n in ("repos", "files", "symbols", "reference_edges", "repo_branches", "chunks")))


def default_branch(col: Column) -> Column:
    """A null default branch means HEAD."""
    return F.coalesce(col, F.lit(HEAD))


def contains(col: Column, needle: str, sensitive: bool) -> Column:
    """Plain substring test, null for a null text; no pattern, so nothing needs escaping."""
    return col.contains(F.lit(needle)) if sensitive else F.lower(col).contains(F.lower(F.lit(needle)))


def matches(col: Column, pattern: str, sensitive: bool) -> Column:
    return col.rlike(to_java(pattern, sensitive))


def has_branch(branch: str | Column) -> Column:
    return F.array_contains("branches", branch)


class Plan:
    """``filter()``: the files an expression selects, with ``repo_name`` and ``default_branch`` beside their columns."""

    def __init__(self, corpus: Corpus, node: Node, sensitive: bool):
        self.corpus, self.node, self.sensitive = corpus, node, sensitive
        self._flags: list[tuple[DataFrame, str]] = []

    def filter(self) -> DataFrame:
        c = self.corpus
        node = self.node
        conjuncts = list(node.children) if isinstance(node, And) else [node]
        needed = [t for t in conjuncts if isinstance(t, Term) and t.kind == "sym"]
        others = [t for t in conjuncts if t not in needed]
        condition = [self._lower(t) for t in others]
        if not names_branches(node):
            condition.append(has_branch(default_branch(F.col("default_branch"))))
        names = c.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"), "default_branch")
        out = c.files.join(broadcast_if_small(names), "repo_id")
        for t in needed:
            out = out.join(self._symbol_files(t.value), out["id"] == F.col("__sym_file"), "left_semi")
        for flags, key in self._flags:
            out = out.join(flags, out[key] == flags["__key"], "left").drop("__key")
        keep = [*c.files.columns, "repo_name", "default_branch"]
        return (out.where(reduce(lambda a, b: a & b, condition)) if condition else out).select(*keep)

    def _symbol_files(self, pattern: str) -> DataFrame:
        s = self.corpus.symbols
        return s.where(contains(F.col("name"), pattern, self.sensitive)).select(F.col("file_id").alias("__sym_file")).distinct()

    def _lower(self, node: Node) -> Column:
        if isinstance(node, Not):
            return ~self._lower(node.child)
        if isinstance(node, And):
            return reduce(lambda a, b: a & b, map(self._lower, node.children))
        if isinstance(node, Or):
            return reduce(lambda a, b: a | b, map(self._lower, node.children))
        return getattr(self, f"_{node.kind}")(node)

    def _substring(self, t: Term) -> Column:
        return contains(F.col("content"), t.value, t.case)

    def _regex(self, t: Term) -> Column:
        return matches(F.col("content"), t.value, t.case)

    def _repo(self, t: Term) -> Column:
        return matches(F.col("repo_name"), t.value, False)

    def _file(self, t: Term) -> Column:
        return matches(F.col("path"), t.value, self.sensitive)

    def _lang(self, t: Term) -> Column:
        return F.col("lang") == F.lit(t.value.strip().lower())

    def _branch(self, t: Term) -> Column:
        return has_branch(t.value)

    def _sym(self, t: Term) -> Column:
        name = f"__f{len(self._flags)}"
        self._flags.append((self._symbol_files(t.value).select(F.col("__sym_file").alias("__key"), F.lit(True).alias(name)), "id"))
        return F.coalesce(F.col(name), F.lit(False))

    def _commit(self, t: Term) -> Column:
        name = f"__f{len(self._flags)}"
        heads = self.corpus.repo_branches.where(F.lower("last_indexed_commit").startswith(t.value))
        heads = heads.groupBy(F.col("repo_id").alias("__key")).agg(F.collect_set("branch").alias(name))
        self._flags.append((heads, "repo_id"))
        return F.coalesce(F.arrays_overlap("branches", name), F.lit(False))


def select_files(corpus: Corpus, node: Node, sensitive: bool | None = None) -> DataFrame:
    """The files that ``node`` selects. ``sensitive`` defaults to what the leaves of ``node`` carry. With a stored table of
    trigrams only the contents of files that can match are read."""
    if sensitive is None:
        sensitive = any(t.case for t, _ in walk(node))
    if corpus.grams is not None:
        corpus = replace(corpus, files=narrowed(corpus.files, corpus.grams, node))
    return Plan(corpus, node, sensitive).filter()


#: The order of results. The id comes last: a version may be stored twice, and a page may end between the two.
FILE_ORDER = ("repo_id", "path", "content_sha", "id")


def after(cursor: tuple) -> Column:
    """Rows past a cursor (repository, path, sha and, where it is known, id) in the order of results."""
    kinds = ("int", "string", "string", "bigint")
    mine = [F.col(c).cast(k).alias(c) for c, k in zip(FILE_ORDER[: len(cursor)], kinds)]
    return F.struct(*mine) > F.struct(*[F.lit(x).cast(k).alias(c) for x, c, k in zip(cursor, FILE_ORDER, kinds)])


def page(files: DataFrame, limit: int | None = 200, cursor: tuple | None = None) -> DataFrame:
    """Files in order, past ``cursor``, ``limit`` at most (0 is legal, negative is not)."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    if cursor is not None:
        files = files.where(after(cursor))
    return files if limit is None else files.orderBy(*FILE_ORDER).limit(limit)
