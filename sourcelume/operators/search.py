"""Operators around search: merged results, commit lookup, permalinks, repository lists and single files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.corpus import HEAD, Corpus, default_branch, has_branch
from ..plans.language import Node, affirmative, walk
from .grep import RESULT, grep
from .symbols import find_symbols


def merged_files(corpus: Corpus, query: str) -> DataFrame:
    """One row a file version with its line matches and symbol definitions: ``matches`` sorted by line, nulls last, and
    ``match_count``, spans and definitions together."""
    keys = [c for c in RESULT if c not in ("branches", "lang")]
    lines = grep(corpus, query).select(*keys, "line", "text", F.size("byte_ranges").alias("n"), F.lit(None).cast("string").alias("symbol"))
    found = find_symbols(corpus, query)
    if found is not None:
        rows = found.select("repo_id", "repo_name", "path", "content_sha", F.col("file_id").alias("id"), F.col("start_line").alias("line"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("n"), F.col("name").alias("symbol"))
        lines = lines.unionByName(rows)
    match = F.struct(F.coalesce("line", F.lit(2**31 - 1)).alias("at"), "line", "text", "symbol")
    out = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(match)).alias("matches"), F.sum("n").alias("match_count"))
    return out.withColumn("matches", F.transform("matches", lambda m: m.dropFields("at")))


def resolve_commits(corpus: Corpus, prefixes: list[str]) -> DataFrame:
    """Branches whose head has one of the prefixes, in (repository, branch) order of the caller's choosing."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.lower("last_indexed_commit").startswith(p.lower())
    repos = corpus.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    return corpus.repo_branches.where(hit).join(repos, "repo_id").select("repo_id", "repo", "branch", F.col("last_indexed_commit").alias("commit"), "last_indexed_at").distinct()


def commit_mood(node: Node) -> str:
    """``bare``: the query only names commits; ``scoped``: it also searches; ``none``: it names no commit to look up. A
    negated commit excludes, so it is none."""
    if not affirmative(node, "commit"):
        return "none"
    return "scoped" if any(t.kind in ("substring", "regex", "sym") for t, _ in walk(node)) else "bare"


def permalink_branch(branches: Column, wanted: list[str]) -> Column:
    """The smallest branch both wanted and present, else the smallest present; null if no branch is asked for."""
    if not wanted:
        return F.lit(None).cast("string")
    both = F.array_intersect(branches, F.array(*map(F.lit, wanted)))
    return F.array_min(F.when(F.size(both) > 0, both).otherwise(branches))


def list_repos(corpus: Corpus) -> DataFrame:
    """Each repository with its branches (``HEAD`` if it has none) and the index state of the default one, or the first."""
    b = corpus.repo_branches.select("repo_id", F.struct("branch", F.col("last_indexed_commit").alias("commit"), "last_indexed_at", "index_semantics_version").alias("b"))
    r = corpus.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"), default_branch(F.col("default_branch")).alias("default_branch"))
    grouped = r.join(b, "repo_id", "left").groupBy("repo_id", "repo", "default_branch").agg(F.sort_array(F.collect_list("b")).alias("rows"))
    own = F.filter("rows", lambda x: x["branch"] == F.col("default_branch"))
    main = F.get(F.when(F.size(own) > 0, own).otherwise(F.col("rows")), F.lit(0))
    names = F.when(F.size("rows") > 0, F.transform("rows", lambda x: x["branch"])).otherwise(F.array(F.lit(HEAD)))
    return grouped.select("repo_id", "repo", "default_branch", names.alias("branches"), main["commit"].alias("commit"), main["last_indexed_at"].alias("last_indexed_at"))


def get_file(corpus: Corpus, repo: str, path: str, branch: str | None = None) -> DataFrame:
    """The version of a file on a branch (the default one if none is named); no row if there is none."""
    r = corpus.repos.where(F.col("name") == repo).select(F.col("id").alias("repo_id"), F.col("name").alias("repo"), "default_branch")
    f = corpus.files.where(F.col("path") == path).join(r, "repo_id")
    return f.where(has_branch(branch) if branch is not None else has_branch(default_branch(F.col("default_branch"))))


def file_lines(files: DataFrame, first: int = 1, count: int | None = None) -> DataFrame:
    """``(id, line, text)`` of the lines of files, split at ``\\n``; from line ``first``, at least one at a time."""
    rows = files.where(F.col("content").isNotNull()).select("id", F.posexplode(F.split("content", "\n", -1)).alias("i", "text"))
    rows = rows.select("id", (F.col("i") + 1).alias("line"), "text").where(F.col("line") >= max(1, first))
    return rows if count is None else rows.where(F.col("line") < max(1, first) + max(1, count))
