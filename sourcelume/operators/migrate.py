"""Tables of an earlier shape brought to the present one: new columns filled from what is known, once for each version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import content_sha
from ..plans.corpus import default_branch
from ..session import broadcast_if_small
from ..sources.snapshots import SnapshotStore


class CannotMigrate(RuntimeError):
    """The data hold something that the wanted shape cannot."""


def _present(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def backfill_shas(files: DataFrame) -> DataFrame:
    """``files`` with a ``content_sha`` in every row; those that are there stay."""
    return files.withColumn("content_sha", F.coalesce(_present(files, "content_sha", "string"), content_sha(F.col("content"))))


def backfill_branches(files: DataFrame, repos: DataFrame) -> DataFrame:
    """``files`` with ``branches`` in every row of a known repository: rows from before there were branches are on the default
    one. Rows of unknown repositories keep their null."""
    main = repos.select(F.col("id").alias("repo_id"), F.array(default_branch(F.col("default_branch"))).alias("__main"))
    rows = files.withColumn("branches", _present(files, "branches", "array<string>"))
    return rows.join(broadcast_if_small(main), "repo_id", "left").withColumn("branches", F.coalesce("branches", "__main")).select(*rows.columns)


def seed_stamps(repos: DataFrame, stamps: DataFrame) -> DataFrame:
    """``stamps`` with a row for the default branch of every repository, which carries the repository's own stamp of old, so
    that what was indexed does not look unindexed. Rows that are there stay."""
    state = ("last_indexed_commit", "index_semantics_version", "last_indexed_at")
    new = repos.select(F.col("id").alias("repo_id"), default_branch(F.col("default_branch")).alias("branch"), *state)
    new = new.join(stamps.select("repo_id", "branch"), ["repo_id", "branch"], "left_anti")
    return stamps.select("repo_id", "branch", *state).unionByName(new)


def multi_version_paths(files: DataFrame) -> DataFrame:
    """``(repo_id, path, versions)`` of paths with more than one row: what a table with one row a path could not hold."""
    return files.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


def indexed_within(stamps: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    """Stamps of the last ``hours``."""
    now = F.current_timestamp() if now is None else now
    return stamps.where(F.col("last_indexed_at") >= now - F.make_interval(hours=F.lit(hours)))


def _branches(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    files = backfill_branches(backfill_shas(tables["files"]), tables["repos"])
    stamps = tables.get("repo_branches")
    if stamps is None:
        stamps = tables["repos"].select(F.col("id").alias("repo_id"), default_branch(F.col("default_branch")).alias("branch"), "last_indexed_commit", "index_semantics_version", "last_indexed_at").limit(0)
    return {"files": files, "repo_branches": seed_stamps(tables["repos"], stamps)}


def _single_branch(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    if not multi_version_paths(tables["files"]).isEmpty():
        raise CannotMigrate("a path has several versions; collapse them before")
    return {"files": tables["files"].drop("branches", "content_sha")}


#: Steps up, by the schema version they lead to, and down, by the one they start from.
UP: dict[int, Callable] = {1: lambda tables: {}, 2: _branches}
DOWN: dict[int, Callable] = {2: _single_branch}
LATEST = max(UP)


def migrate(spark: SparkSession, store: SnapshotStore, to: int = LATEST) -> list[int]:
    """Brings a store to schema version ``to``, a version of the store for each step; the steps done. One that cannot be done
    leaves the store as it was."""
    done = []
    while (at := store.manifest()["note"].get("schema", 1)) != to:
        expected = store.version()
        tables = {t: store.read(spark, t) for t in store.manifest()["tables"]}
        step, lands = (UP[at + 1], at + 1) if at < to else (DOWN[at], at - 1)
        store.commit(step(tables), expected, note={"schema": lands})
        done.append(lands)
    return done
