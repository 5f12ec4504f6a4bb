"""Call and import references, resolved to ranked candidate definitions by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.corpus import HEAD, Corpus, default_branch, has_branch
from ..session import broadcast_if_small

CAP = 32
#: Kinds of symbols that a call can mean.
CALLABLE = ("function", "method", "class")


def _in_branch(branch: str | None) -> Column:
    return has_branch(branch) if branch is not None else has_branch(default_branch(F.col("default_branch")))


def _files(corpus: Corpus, branch: str | None, prefix: str) -> DataFrame:
    """Files of the branch (of every repository's default branch if None) under prefixed names."""
    repos = corpus.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"), "default_branch")
    f = corpus.files.select(F.col("id").alias("file_id"), "repo_id", "path", "branches").join(broadcast_if_small(repos), "repo_id").where(_in_branch(branch))
    return f.select(*[F.col(c).alias(prefix + c) for c in ("file_id", "repo_id", "path", "repo")])


def sites(corpus: Corpus, target: str | None = None, kind: str | None = None, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """Reference edges with the file they stand in. An edge delivered twice is one site."""
    e = corpus.reference_edges.dropDuplicates(["id"])
    if target is not None:
        e = e.where(F.col("target_name") == target)
    if kind is not None:
        e = e.where(F.col("edge_kind") == kind)
    e = e.select(F.col("id").alias("edge_id"), "file_id", "edge_kind", "target_name", "line", "enclosing_name", "enclosing_kind", "enclosing_start_line", "enclosing_end_line")
    out = e.join(_files(corpus, branch, ""), "file_id")
    return out.where(F.col("repo") == repo) if repo is not None else out


def definitions(corpus: Corpus, branch: str | None = None) -> DataFrame:
    """Symbols a name may mean, with prefixed names; a symbol delivered twice is one."""
    s = corpus.symbols.dropDuplicates(["id"]).select(
        F.col("id").alias("c_symbol_id"), F.col("file_id").alias("c_file_id"), F.col("name").alias("target_name"), F.col("kind").alias("c_kind"), F.col("start_line").alias("c_start_line"), F.col("end_line").alias("c_end_line")
    )
    return s.join(_files(corpus, branch, "c_"), "c_file_id")


def candidate_counts(corpus: Corpus, branch: str | None = None) -> DataFrame:
    """How many definitions each name has, before any cap."""
    return definitions(corpus, branch).groupBy("target_name").agg(F.count(F.lit(1)).alias("candidate_count"))


def capped_definitions(corpus: Corpus, branch: str | None = None, cap: int = CAP) -> DataFrame:
    """The first ``cap`` definitions of each name. The rank stands alone in its select, so the window keeps only ``cap``
    rows a name while it sorts; the true counts come from an aggregation of their own."""
    order = [F.asc_nulls_last(c) for c in ("c_repo_id", "c_path", "c_start_line", "c_symbol_id")]
    ranked = definitions(corpus, branch).withColumn("nth", F.row_number().over(W.partitionBy("target_name").orderBy(*order)))
    return ranked.where(F.col("nth") <= cap)


def resolution(count: Column) -> Column:
    return F.when(count == 1, "unique").when(count > 1, "ambiguous").otherwise("unresolved")


def resolve(corpus: Corpus, target: str | None = None, kind: str | None = None, repo: str | None = None, branch: str | None = None, cap: int = CAP) -> DataFrame:
    """Sites with ``candidate_count`` and ``resolution``, which do not depend on the cap."""
    counts = candidate_counts(corpus, branch)
    s = sites(corpus, target, kind, repo, branch).join(counts, "target_name", "left")
    n = F.coalesce("candidate_count", F.lit(0))
    return s.withColumn("candidate_count", n).withColumn("resolution", resolution(F.col("candidate_count")))


def ranked_candidates(site_rows: DataFrame, corpus: Corpus, branch: str | None = None, cap: int = CAP) -> DataFrame:
    """One row a site and candidate: same repository first, then callable kinds for calls, then the same file, then place.

    Names with very many sites and definitions are what a join on the name is skewed by; candidates are capped before it,
    so a name contributes at most ``cap`` rows to each of its sites.
    """
    c = capped_definitions(corpus, branch, cap).drop("nth")
    pairs = site_rows.join(c, "target_name")
    same_repo = F.col("repo_id") == F.col("c_repo_id")
    kind_match = (F.col("edge_kind") == "call") & F.coalesce(F.col("c_kind").isin(*CALLABLE), F.lit(False))
    same_file = F.col("file_id") == F.col("c_file_id")
    order = [same_repo.desc(), kind_match.desc(), same_file.desc(), "c_repo_id", "c_path", F.coalesce("c_start_line", F.lit(0)), "c_symbol_id"]
    return pairs.withColumn("same_repo", same_repo).withColumn("kind_match", kind_match).withColumn("candidate_rank", F.row_number().over(W.partitionBy("edge_id").orderBy(*order)))


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """One row: how many sites are unique, ambiguous and unresolved."""
    return resolved.agg(*[F.count(F.when(F.col("resolution") == k, 1)).alias(k) for k in ("unique", "ambiguous", "unresolved")])


def resolution_distribution(resolved: DataFrame) -> DataFrame:
    """Counts and percentages by kind of edge."""
    by = resolved.groupBy("edge_kind", "resolution").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("edge_kind")), 4))


def ambiguity_histogram(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolution = 'ambiguous'").groupBy("candidate_count").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["CAP", "HEAD", "ambiguity_histogram", "candidate_counts", "capped_definitions", "definitions", "ranked_candidates", "resolution_distribution", "resolution_summary", "resolve", "sites"]
