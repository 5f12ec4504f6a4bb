"""A trigram table beside the files: which files can hold a literal, without reading contents (see ``plans.narrow``).

The table is narrow (a trigram and a file) and sorted by trigram when written, so that a lookup reads the few row groups its
trigrams lie in.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..plans.corpus import Corpus
from ..plans.language import Node
from ..plans.narrow import candidates, narrowed, trigrams


def build(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``(gram, file_id)``, each pair once; contents of under three characters and null ones have none."""
    # pairs of neighbouring characters joined with the next ones: one pass, where a substring at each place would need many
    chars = F.filter(F.split(F.lower(content), ""), lambda c: c != "")
    pairs = lambda a, n: F.zip_with(a, F.slice("__c", n, F.greatest(F.size("__c"), F.lit(1))), lambda x, y: F.concat(x, y))
    grams = F.array_distinct(F.filter(pairs(pairs(F.col("__c"), 2), 3), lambda g: g.isNotNull()))
    rows = files.where(F.col(content).isNotNull() & (F.length(content) >= 3)).select(F.col(key).alias("file_id"), chars.alias("__c"))
    rows = rows.select("file_id", F.explode(grams).alias("gram"))
    return rows.select("gram", "file_id").distinct()


def write(table: DataFrame, path: str, tasks: int) -> None:
    """The table in ranges of trigrams; those of every file are split by file as well, so that no task holds one alone."""
    table.repartitionByRange(tasks, "gram", "file_id").sortWithinPartitions("gram", "file_id").write.mode("overwrite").parquet(path)


def narrow(corpus: Corpus, table: DataFrame, node: Node) -> Corpus:
    """``corpus`` with only the files that can match."""
    return replace(corpus, files=narrowed(corpus.files, table, node))


__all__ = ["build", "candidates", "narrow", "trigrams", "write"]
