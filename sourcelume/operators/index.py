"""Incremental indexing as relational operators: what a new snapshot changes, and the tables after it.

All branches of all repositories go through together. ``incoming`` has one row a file of a snapshot: ``repo_id, branch,
path, lang, size, content, commit, content_sha`` and ``ord``. Stored ``files`` have one row a content version, with the
branches that carry it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import content_sha
from ..session import broadcast_if_few, broadcast_if_small

KEY = ("repo_id", "path", "content_sha")


def stamp_contents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content_sha", content_sha(F.col("content")))


def last_of_each(incoming: DataFrame) -> DataFrame:
    """One row for each (branch, path, content): the last delivered."""
    w = W.partitionBy("repo_id", "branch", "path", "content_sha").orderBy(F.desc("ord"))
    return incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def current_repos(stamps: DataFrame, version: int) -> DataFrame:
    """Repositories all of whose branches were indexed with the rules of ``version``; a null version is out of date."""
    same = F.coalesce(F.col("index_semantics_version") == version, F.lit(False))
    return stamps.groupBy("repo_id").agg(F.min(same).alias("current")).where("current").select("repo_id")


def gates(stamps: DataFrame, version: int) -> DataFrame:
    """``(repo_id, branch, own, siblings)`` of stamped branches: whether the branch, and whether every branch of its
    repository, was indexed with the rules of ``version``."""
    same = F.coalesce(F.col("index_semantics_version") == version, F.lit(False))
    every = current_repos(stamps, version).withColumn("siblings", F.lit(True))
    rows = stamps.groupBy("repo_id", "branch").agg(F.max(same).alias("own")).join(every, "repo_id", "left")
    return rows.select("repo_id", "branch", "own", F.coalesce("siblings", F.lit(False)).alias("siblings"))


def classify(incoming: DataFrame, files: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """``incoming`` with ``class``: ``carried`` (this branch has this content already), ``membership`` (another branch
    has), ``changed`` (new).

    What is stored was extracted by the rules of its time. ``gate`` (see ``gates``) tells what can be trusted: nothing of a
    branch that is not at the present rules itself; and ``membership``, which relies on what other branches wrote, only
    where all of them are. What cannot be trusted is ``changed``."""
    stored = files.groupBy(*KEY).agg(F.flatten(F.collect_list("branches")).alias("__b"))
    out = incoming.join(stored, list(KEY), "left")
    own = siblings = F.lit(True)
    if gate is not None:
        out = out.join(broadcast_if_small(gate), ["repo_id", "branch"], "left")
        own, siblings = (F.coalesce(c, F.lit(False)) for c in ("own", "siblings"))
    kind = F.when(F.col("__b").isNull() | ~own, "changed").when(F.array_contains("__b", F.col("branch")), "carried").when(siblings, "membership").otherwise("changed")
    return out.select(*incoming.columns, kind.alias("class"))


def _no_branches() -> Column:
    return F.array().cast("array<string>")


def file_changes(files: DataFrame, incoming: DataFrame, whole_branches: bool) -> DataFrame:
    """What a run does to the stored files, without any content: ``id`` (null for a new file), its key, ``new`` (the
    delivered attributes, null if the row was not delivered) and ``after``, its branches then (empty: to be deleted). Rows
    that stay as they are are left out.

    ``whole_branches``: every snapshot's branch is taken off the rows it does not hold. A branch without any row in
    ``incoming`` is not touched, so an empty snapshot deletes nothing.
    """
    new = incoming.groupBy(*KEY).agg(
        F.max_by(F.struct("lang", "size", "commit", F.col("content").isNull().alias("lost"), "ord", "branch"), F.struct("ord", "branch")).alias("new"), F.collect_set("branch").alias("more")
    )
    old = files.select(*KEY, F.col("id").cast("long").alias("id"), "branches")
    both = old.join(new, list(KEY), "full_outer")
    more = F.coalesce("more", _no_branches())
    after = F.coalesce("branches", _no_branches())
    if whole_branches:
        indexed = incoming.groupBy("repo_id").agg(F.collect_set("branch").alias("__indexed"))
        both = both.join(broadcast_if_small(indexed), "repo_id", "left")
        after = F.array_except(after, F.array_except(F.coalesce("__indexed", _no_branches()), more))
    both = both.withColumn("after", F.array_sort(F.array_union(after, more)))
    return both.where(F.col("new").isNotNull() | ~F.col("after").eqNullSafe(F.col("branches"))).select("id", *KEY, "new", "after")


def apply_changes(files: DataFrame, incoming: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored files after ``changes``: a delivered row replaces the stored attributes, files that no branch carries are
    gone. New rows get an id from their key, which stays the same whatever else is in the run.

    Contents of stored files are not moved while the changes can be broadcast; of delivered ones only the new are.
    """
    old = changes.where("id IS NOT NULL").select("id", "new", "after")
    rows = files.withColumn("id", F.col("id").cast("long")).join(broadcast_if_few(old), "id", "left")
    delivered = F.col("new").isNotNull()
    content = F.when(~delivered, F.col("content")).when(~F.col("new.lost"), F.coalesce("content", F.lit("")))
    pick = lambda c: F.when(delivered, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    kept = rows.where(F.col("after").isNull() | (F.size("after") > 0)).select(
        "id", "repo_id", "path", pick("lang"), pick("size"), content.alias("content"), pick("commit"), "content_sha", F.coalesce("after", "branches").alias("branches")
    )
    fresh = changes.where("id IS NULL").select(*KEY, "after", F.col("new.ord").alias("ord"), F.col("new.branch").alias("branch"))
    rows = incoming.join(broadcast_if_few(fresh), [*KEY, "ord", "branch"]).dropDuplicates(list(KEY))
    added = rows.select(F.xxhash64(*KEY).alias("id"), "repo_id", "path", "lang", "size", "content", "commit", "content_sha", F.col("after").alias("branches"))
    return kept.unionByName(added)


def merge_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored files after an upsert: a delivered row replaces the stored attributes, branches are united and sorted."""
    return apply_changes(files, incoming, file_changes(files, incoming, whole_branches=False))


def _without(files: DataFrame, gone: Column) -> DataFrame:
    """Files with the branches ``gone`` taken off; files that no branch carries any more are deleted."""
    left = files.withColumn("branches", F.array_except("branches", F.coalesce(gone, _no_branches())))
    return left.where(F.size("branches") > 0)


def sweep(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """Files after every snapshot's branch was taken off the rows it does not hold, however little of them is new."""
    return apply_changes(files, incoming, file_changes(files, incoming, whole_branches=True).where("id IS NOT NULL").withColumn("new", F.lit(None).cast("struct<lang:string,size:int,commit:string,lost:boolean,ord:bigint,branch:string>")))


def retire(files: DataFrame, stamps: DataFrame, retired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, stamps) without the branches of ``retired`` (repo_id, branch); null and empty names retire nothing."""
    real = retired.where(F.col("branch").isNotNull() & (F.trim("branch") != "")).select("repo_id", "branch").distinct()
    gone = real.groupBy("repo_id").agg(F.collect_set("branch").alias("__gone"))
    rows = _without(files.join(gone, "repo_id", "left"), F.col("__gone")).select(*files.columns)
    return rows, stamps.join(real, ["repo_id", "branch"], "left_anti")


def purge(table: DataFrame, keep: DataFrame, key: str = "repo_id") -> DataFrame:
    """Rows of repositories in ``keep`` (one column, ``repo_id``); an empty ``keep`` is an error, never a purge of all."""
    if keep.isEmpty():
        raise ValueError("refusing to purge everything")
    return table.join(keep.select(F.col("repo_id").alias(key)).distinct(), key, "left_semi")


def cascade(children: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of files that still exist."""
    return children.join(files.select(F.col("id").alias(key)), key, "left_semi")


def replace_children(children: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of unchanged files, and the new ones of changed files (which may have none)."""
    return children.join(changed.select(F.col("id").alias(key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def sink_chunks(chunks: DataFrame, delivered: DataFrame) -> DataFrame:
    """``chunks`` after a delivery: ``delivered`` has ``file_id, ord`` and ``chunks``, an array of the file's new rows without its
    id. Of a file delivered more than once the last counts; one with an empty or null array loses its chunks."""
    last = delivered.groupBy("file_id").agg(F.max_by("chunks", "ord").alias("c"))
    new = last.select("file_id", F.inline("c"))
    return chunks.join(broadcast_if_small(last.select("file_id")), "file_id", "left_anti").unionByName(new, allowMissingColumns=True)


def work_list(heads: DataFrame, stamps: DataFrame, version: int) -> DataFrame:
    """Branches of ``heads`` (repo_id, branch, commit) that are not stamped with this commit and version."""
    done = stamps.where(F.col("index_semantics_version") == version).select("repo_id", "branch", F.col("last_indexed_commit").alias("commit"))
    return heads.join(done, ["repo_id", "branch", "commit"], "left_anti")


def next_stamps(stamps: DataFrame, indexed: DataFrame, version: int, now: Column | None = None) -> DataFrame:
    """Stamps after a run: ``indexed`` has ``repo_id, branch, commit, parsed``; a branch of which nothing was parsed keeps
    its old version, so that a rule change is not marked done by a run that did not apply it."""
    now = F.current_timestamp() if now is None else now
    s = stamps.select("repo_id", "branch", F.struct("last_indexed_commit", "index_semantics_version", "last_indexed_at").alias("old"))
    n = indexed.select("repo_id", "branch", F.struct("commit", "parsed").alias("new"))
    both = s.join(n, ["repo_id", "branch"], "full_outer")
    done = F.col("new").isNotNull()
    moved = done & (F.col("new.parsed") > 0)
    return both.select(
        "repo_id", "branch", F.when(done, F.col("new.commit")).otherwise(F.col("old.last_indexed_commit")).alias("last_indexed_commit"),
        F.when(moved | (done & F.col("old").isNull()), F.lit(version)).otherwise(F.col("old.index_semantics_version")).cast("int").alias("index_semantics_version"),
        F.when(done, now).otherwise(F.col("old.last_indexed_at")).alias("last_indexed_at"),
    )


@dataclass(frozen=True)
class RunOutcome:
    """What a run must show before anything is retired or purged."""

    failures: int = 0
    conflicts: int = 0
    all_repos: bool = True
    all_complete: bool = True

    @property
    def may_reconcile(self) -> bool:
        return self.failures == 0 and self.conflicts == 0 and self.all_repos and self.all_complete


def may_purge(stored: int, to_purge: int) -> bool:
    """Whether a purge is plausible: not more than half of what is stored."""
    return to_purge * 2 <= stored


MAX_CHUNKS = 8000


def degraded_branches(chunks: DataFrame, files: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    """``(repo_id, branch, chunks)`` of branches with more than ``most`` chunks: they are indexed without chunks and marked
    degraded, so that one huge branch does not fail a run."""
    per_file = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rows = files.select(F.col("id").alias("file_id"), "repo_id", F.explode("branches").alias("branch")).join(per_file, "file_id")
    return rows.groupBy("repo_id", "branch").agg(F.sum("n").alias("chunks")).where(F.col("chunks") > most)


def run_report(deliveries: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row a wanted branch (``repo_id, branch``): how many files came, the first error if any, and ``status``:
    ``indexed``, ``failed`` or ``missing``. A branch that failed says nothing about the others."""
    got = deliveries.groupBy("repo_id", "branch").agg(F.count("path").alias("files"), F.min("error").alias("error"))
    out = wanted.select("repo_id", "branch").distinct().join(got, ["repo_id", "branch"], "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("files").isNull(), "missing").otherwise("indexed")
    return out.select("repo_id", "branch", F.coalesce("files", F.lit(0)).alias("files"), "error", status.alias("status"))


def outcome(report: DataFrame, conflicts: int = 0) -> RunOutcome:
    """What a report allows: nothing is retired or purged after a run with a failed or missing branch."""
    row = report.agg(F.count(F.when(F.col("status") == "failed", 1)), F.count(F.when(F.col("status") == "missing", 1))).first()
    return RunOutcome(failures=row[0], conflicts=conflicts, all_repos=row[1] == 0, all_complete=row[1] == 0)
