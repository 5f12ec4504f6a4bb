"""Line-level matching: the files a query selects, and in them every line it matches with UTF-8 byte ranges."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.corpus import FILE_ORDER, Corpus, select_files
from ..plans.language import Node, affirmative, case_of, parse
from ..plans.regex_dialect import max_width

try:
    import regex as engine
except ImportError:  # without it patterns have no time limit
    engine = re


@dataclass(frozen=True)
class Matchers:
    """Compiled patterns of the affirmative content terms, and what they say about the query's shape."""

    patterns: tuple[tuple[str, bool], ...]
    regex_incompatible: bool

    @classmethod
    def of(cls, node: Node) -> Matchers:
        found, broken = [], False
        for t in affirmative(node, "substring", "regex"):
            pattern = re.escape(t.value) if t.kind == "substring" else t.value
            try:
                engine.compile(pattern)
                found.append((pattern, t.case))
            except (re.error, getattr(engine, "error", re.error)):
                broken = True
        return cls(tuple(found), broken)

    @property
    def no_content_atom(self) -> bool:
        return not self.patterns and not self.regex_incompatible

    @property
    def zero_width_only(self) -> bool:
        return bool(self.patterns) and all(max_width(p) == 0 for p, _ in self.patterns)


def line_spans(line: str, compiled: list, timeout: float | None = None) -> list[tuple[int, int]]:
    """Character spans of all patterns in a line, united where they overlap or touch; empty matches do not count."""
    spans = sorted(m.span() for p in compiled for m in (p.finditer(line, timeout=timeout) if timeout else p.finditer(line)) if m.end() > m.start())
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def byte_spans(line: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    if line.isascii():
        return [list(s) for s in spans]
    return [[len(line[:s].encode("utf-8", "surrogatepass")), len(line[:e].encode("utf-8", "surrogatepass"))] for s, e in spans]


def match_lines(content: str, compiled: list, timeout: float | None = None) -> Iterator[tuple[int, str, list[list[int]]]]:
    for n, line in enumerate(content.split("\n"), 1):
        line = line.removesuffix("\r")
        if spans := line_spans(line, compiled, timeout):
            yield n, line, byte_spans(line, spans)


def compile_all(patterns: tuple[tuple[str, bool], ...]) -> list:
    return [engine.compile(p, 0 if case else engine.IGNORECASE) for p, case in patterns]


def _highlight(patterns: tuple[tuple[str, bool], ...], budget_s: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_all(patterns)
        for b in batches:
            which, ns, texts, spans = [], [], [], []
            for i, content in enumerate(b.column(b.num_columns - 1).to_pylist()):
                began = time.monotonic()
                try:
                    rows = list(match_lines(content or "", compiled, budget_s if engine is not re else None))
                except TimeoutError:
                    rows = [(None, None, None)]
                if budget_s and time.monotonic() - began > budget_s:
                    rows = [(None, None, None)]
                for n, line, s in rows:
                    which.append(i)
                    ns.append(n)
                    texts.append(line)
                    spans.append(s)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in b.columns[:-1]), pa.array(ns, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                names=[*b.schema.names[:-1], "line", "text", "byte_ranges"],
            )

    return run


RESULT = ("repo_id", "repo_name", "path", "content_sha", "id", "lang", "branches")


def highlight(files: DataFrame, matchers: Matchers, budget_s: float | None = None) -> DataFrame:
    """One row a matching line of ``files``: ``RESULT``'s columns, ``line`` (from 1), ``text`` and ``byte_ranges``.

    Only rows with a content take part. A file on which the patterns take longer than ``budget_s`` is given up, which one
    row says whose ``line``, ``text`` and ``byte_ranges`` are null.
    """
    rows = files.where(F.col("content").isNotNull()).select(*RESULT, "content")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_highlight(matchers.patterns, budget_s), f"{kept}, line int, text string, byte_ranges array<array<int>>")


def grep(corpus: Corpus, query: str | Node, files: DataFrame | None = None) -> DataFrame:
    """Every line that a query matches. AND restricts files; a line shows if it matches any affirmative content term."""
    node = parse(query) if isinstance(query, str) else query
    sensitive = case_of(query) if isinstance(query, str) else None
    files = select_files(corpus, node, sensitive) if files is None else files
    return highlight(files, Matchers.of(node))


def within_bytes(files: DataFrame, cap: int) -> DataFrame:
    """Files in order as long as their contents fit: a file counts with its characters when it is tested and with its
    bytes after. One running sum over the ordered page; meant for the bounded pages of a service."""
    ahead = F.sum(F.octet_length(F.coalesce("content", F.lit("")))).over(W.orderBy(*FILE_ORDER).rowsBetween(W.unboundedPreceding, -1))
    tested = files.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).withColumn("__over", F.col("__ahead") + F.length(F.coalesce("content", F.lit(""))) > cap)
    stopped = F.max(F.col("__over").cast("int")).over(W.orderBy(*FILE_ORDER).rowsBetween(W.unboundedPreceding, 0))
    return tested.withColumn("__stop", stopped).where("__stop = 0").drop("__ahead", "__over", "__stop")
