"""An index run: what was delivered of repositories' branches becomes files, symbols, references, chunks and stamps of the next
version of a store; branches and repositories that are no longer wanted leave it.

Only the parts of the store that hold the run's repositories are read and written. Contents are parsed where their
extraction cannot be reused; what a run of the same rules stored already is carried over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.chunks import chunk_files, embed_chunks, hash_embedder
from ..functions.extract import edges_of, extract_files, symbols_of
from ..functions.search_vector import search_vector
from ..plans.corpus import Corpus, default_branch
from ..session import broadcast_if_few, broadcast_if_small, cut_lineage
from ..sources.snapshots import SnapshotStore
from . import index as idx
from .semantic import postings
from .trigrams import build as build_trigrams

SCHEMAS = {
    "repos": "id int, name string, default_branch string, last_indexed_commit string, last_indexed_at timestamp, index_semantics_version int",
    "repo_branches": "repo_id int, branch string, last_indexed_commit string, index_semantics_version int, last_indexed_at timestamp",
    "files": "id long, repo_id int, path string, lang string, size int, content string, commit string, content_sha string, branches array<string>",
    "symbols": "id long, file_id long, repo_id int, name string, kind string, start_line int, end_line int",
    "reference_edges": "id long, repo_id int, file_id long, edge_kind string, target_name string, line int, enclosing_name string, enclosing_kind string, enclosing_start_line int, enclosing_end_line int",
    "chunks": "id long, file_id long, repo_id int, chunk_index int, content string, start_line int, end_line int, embedding array<float>, ts string",
    "grams": "repo_id int, gram string, file_id long",
    "postings": "repo_id int, word string, chunk_id long, file_id long, n int, len int",
}
#: Tables that hang on files, and the order in which the indexes are written, by which lookups find their few row groups.
CHILDREN = ("symbols", "reference_edges", "chunks", "grams", "postings")
SORTED = {"grams": ("gram", "file_id"), "postings": ("word", "chunk_id"), "files": ("id",)}
#: Delivered rows, ``path`` null for a branch without indexable files or with an ``error``.
DELIVERED = "repo_id int, branch string, path string, lang string, size int, content string, commit string, ord long, error string"


@dataclass(frozen=True)
class Rules:
    """How contents are turned into rows. A change of them needs another ``version``, by which everything is done anew."""

    version: int = 1
    chunks: bool = True
    dim: int = 128
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    most_chunks: int = idx.MAX_CHUNKS


@dataclass
class Report:
    """What a run did. ``status`` has a row a wanted branch (see ``index.run_report``)."""

    version: int
    status: list[tuple] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    degraded: list[tuple] = field(default_factory=list)
    swept: int = 0
    retired: int = 0
    purged: int = 0


def stored(spark: SparkSession, store: SnapshotStore, table: str, buckets: set[int] | None = None) -> DataFrame:
    """A table of the store, or an empty one where there is none yet."""
    if table not in store.manifest()["tables"]:
        return spark.createDataFrame([], SCHEMAS[table])
    return store.read(spark, table, buckets=None if table == "repos" else buckets)


def stored_corpus(spark: SparkSession, store: SnapshotStore) -> Corpus:
    """The current version as the relations that queries run over."""
    repos, files, symbols, edges, branches, chunks, grams, words = (stored(spark, store, t) for t in ("repos", "files", "symbols", "reference_edges", "repo_branches", "chunks", "grams", "postings"))
    return Corpus(repos, files, symbols, edges, branches, chunks.drop("repo_id"), grams, words)


def upsert_repos(repos: DataFrame, wanted: DataFrame, version: int) -> DataFrame:
    """Repositories after a run: those of ``wanted`` (``repo, default_branch, branch, commit, parsed``; ``parsed`` null for a
    branch that was not indexed) exist, and one whose default branch was indexed has its stamp. New ones get the next ids in
    order of their names; they are as many as a run may have."""
    names = wanted.groupBy(F.col("repo").alias("name")).agg(F.max("default_branch").alias("d"), F.max_by("commit", F.col("branch")).alias("any"))
    main = wanted.where((F.col("branch") == default_branch(F.col("default_branch"))) & F.col("parsed").isNotNull()).groupBy(F.col("repo").alias("name")).agg(F.max("commit").alias("c"))
    known = repos.join(names.join(main, "name", "left").drop("any"), "name", "full_outer")
    top = F.coalesce(F.max("id").over(W.partitionBy(F.lit(0))), F.lit(0))
    number = F.row_number().over(W.partitionBy(F.col("id").isNull()).orderBy("name"))
    ids = F.coalesce("id", (top + number).cast("int"))
    done = F.col("c").isNotNull()
    return known.select(
        ids.alias("id"), "name", F.coalesce("d", "default_branch").alias("default_branch"), F.coalesce("c", "last_indexed_commit").alias("last_indexed_commit"),
        F.when(done, F.current_timestamp()).otherwise(F.col("last_indexed_at")).alias("last_indexed_at"), F.when(done, F.lit(version)).otherwise(F.col("index_semantics_version")).cast("int").alias("index_semantics_version"),
    )


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Ids of child rows from their file and their content, the same in every run."""
    n = F.row_number().over(W.partitionBy("file_id", *by).orderBy(*by))
    return rows.withColumn("__n", n).withColumn("id", F.xxhash64("file_id", *by, "__n")).drop("__n")


def children(spark: SparkSession, files: DataFrame, classes: DataFrame, old: dict[str, DataFrame], rules: Rules) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables ``CHILDREN`` after the run, degraded branches). ``files`` are those after the run,
    ``classes`` the classified deliveries ``(repo_id, branch, path, content_sha, class)``."""
    key = list(idx.KEY)
    ids = files.select("id", *key)
    touched = cut_lineage(classes.join(ids, key).groupBy("id").agg(F.max((F.col("class") == "changed").cast("int")).alias("changed"), F.max((F.col("class") == "membership").cast("int")).alias("joined")))
    changed = touched.where("changed = 1").select("id")
    todo = files.join(broadcast_if_few(changed), "id", "left_semi")
    parsed = cut_lineage(extract_files(todo.select("id", "lang", "content")))
    repo_of = ids.select(F.col("id").alias("file_id"), "repo_id")
    symbols = _numbered(symbols_of(parsed), "name", "start_line", "end_line", "kind").join(repo_of, "file_id")
    edges = _numbered(edges_of(parsed), "edge_kind", "target_name", "line", "enclosing_name", "enclosing_start_line").join(repo_of, "file_id")
    out = {"symbols": idx.replace_children(old["symbols"], symbols, changed), "reference_edges": idx.replace_children(old["reference_edges"], edges, changed)}
    out["grams"] = idx.replace_children(old["grams"], build_trigrams(todo).join(repo_of, "file_id"), changed)
    degraded = spark.createDataFrame([], "repo_id int, branch string, chunks long")
    if rules.chunks:
        # a file that another branch stored may have been stored without chunks
        has = old["chunks"].select(F.col("file_id").alias("id")).distinct()
        bare = touched.where("changed = 0 AND joined = 1").select("id").join(has, "id", "left_anti")
        need = cut_lineage(changed.unionByName(bare).distinct())
        cut = cut_lineage(chunk_files(files.join(broadcast_if_few(need), "id", "left_semi").select("id", "content")))
        owed = classes.where(F.col("class") != "carried").join(ids, key).select("repo_id", "branch", F.col("id").alias("file_id")).distinct()
        sizes = cut.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        per_branch = owed.join(sizes, "file_id").groupBy("repo_id", "branch").agg(F.sum("n").alias("chunks"))
        degraded = cut_lineage(per_branch.where(F.col("chunks") > rules.most_chunks))
        # a file is written if a branch that is not degraded owes it
        written = cut_lineage(owed.join(broadcast_if_small(degraded), ["repo_id", "branch"], "left_anti").join(need.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select(F.col("file_id").alias("id")).distinct())
        rows = cut.join(written.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
        rows = embed_chunks(rows, rules.embedder or hash_embedder(rules.dim), rules.dim).withColumn("ts", search_vector(F.col("content")))
        rows = rows.join(repo_of, "file_id").withColumn("id", F.xxhash64("file_id", "chunk_index"))
        # new contents without chunks must not keep those of the old rules
        rows = cut_lineage(rows)
        out["chunks"] = idx.replace_children(old["chunks"], rows, written)
        out["postings"] = idx.replace_children(old["postings"], postings(rows), written)
    else:
        out["chunks"], out["postings"] = old["chunks"], old["postings"]
    alive = ids.select("id")
    return {t: idx.cascade(rows, alive).select(*spark.createDataFrame([], SCHEMAS[t]).columns) for t, rows in out.items()}, degraded


def index_rows(spark: SparkSession, store: SnapshotStore, incoming: DataFrame, heads: DataFrame, rules: Rules, whole_branches: bool = True) -> tuple[dict[str, DataFrame], set[int], DataFrame, DataFrame, int]:
    """(tables after ``incoming``, parts they fill, classes, degraded branches, files swept). ``incoming`` has the delivered rows of indexed
    branches (``repo_id, branch, path, lang, size, content, commit, ord``), ``heads`` a row for each of these branches
    (``repo_id, branch, commit, parsed``)."""
    buckets = {r[0] for r in heads.select(store.bucket(F.col("repo_id"))).distinct().collect()}
    old = {t: stored(spark, store, t, buckets) for t in SCHEMAS}
    incoming = cut_lineage(idx.stamp_contents(incoming.where(F.col("path").isNotNull())))
    gate = idx.gates(old["repo_branches"], rules.version)
    light = incoming.select("repo_id", "branch", "path", "content_sha").distinct()
    classes = cut_lineage(idx.classify(light, old["files"].select(*idx.KEY, "branches"), gate))
    changes = cut_lineage(idx.file_changes(old["files"], incoming, whole_branches))
    files = idx.apply_changes(old["files"], incoming, changes)
    rest, degraded = children(spark, files, classes, old, rules)
    stamps = idx.next_stamps(old["repo_branches"], heads, rules.version)
    swept = changes.where("id IS NOT NULL AND size(after) = 0").count()
    return {"files": files, **rest, "repo_branches": stamps}, buckets, classes, degraded, swept


def run(spark: SparkSession, store: SnapshotStore, deliveries: DataFrame, wanted: DataFrame, rules: Rules = Rules(), reconcile: bool = True) -> Report:
    """Indexes ``deliveries`` (``repo, branch, ord, path, lang, size, content, error``) of the branches ``wanted`` (``repo,
    default_branch, branch, commit``), all of them that there should be, as the next version of ``store``.

    Branches that are stamped with their commit and the present rules are skipped. A branch with an error, or of which
    nothing came, stays as it was and says so in the report; one that came without indexable files keeps its rows and its
    old rules. After a run without failures, branches and repositories that are not wanted are taken out; if that were more
    than half of the repositories, none is. Another run that committed meanwhile makes this one a ``StaleSnapshot``.
    """
    expected = store.version()
    repos, stamps = stored(spark, store, "repos"), stored(spark, store, "repo_branches")
    wanted = cut_lineage(wanted.select("repo", "default_branch", "branch", "commit").distinct())
    known = cut_lineage(upsert_repos(repos, wanted.withColumn("parsed", F.lit(None).cast("long")), rules.version))
    by_name = known.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    heads = wanted.join(broadcast_if_small(by_name), "repo").select("repo_id", "repo", "default_branch", "branch", "commit")
    todo = cut_lineage(idx.work_list(heads.select("repo_id", "branch", "commit"), stamps, rules.version))
    arrived = deliveries.join(broadcast_if_small(by_name), "repo").join(broadcast_if_small(todo), ["repo_id", "branch"])
    status = cut_lineage(idx.run_report(arrived, todo))
    done = todo.join(status.where("status = 'indexed'").select("repo_id", "branch", F.col("files").alias("parsed")), ["repo_id", "branch"])
    done = cut_lineage(done)
    rows = arrived.join(broadcast_if_small(done.select("repo_id", "branch")), ["repo_id", "branch"])
    incoming = rows.select("repo_id", "branch", "path", "lang", F.col("size").cast("int").alias("size"), "content", "commit", "ord")
    tables, buckets, classes, degraded, swept = index_rows(spark, store, incoming, done, rules)
    names = wanted.join(by_name, "repo").join(done.select("repo_id", "branch", "parsed"), ["repo_id", "branch"], "left")
    tables["repos"] = upsert_repos(repos, names, rules.version)
    report = Report(expected + 1)
    report.status = [tuple(r) for r in status.select("repo_id", "branch", "files", "error", "status").orderBy("repo_id", "branch").collect()]
    report.counts = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}
    report.swept = swept
    report.degraded = [tuple(r) for r in degraded.orderBy("repo_id", "branch").collect()]
    if reconcile and idx.outcome(status).may_reconcile:
        buckets = _reconcile(spark, store, tables, heads, buckets, report)
    store.commit(tables, expected, buckets, sort=SORTED)
    return report


def _reconcile(spark: SparkSession, store: SnapshotStore, tables: dict[str, DataFrame], heads: DataFrame, buckets: set[int], report: Report) -> set[int]:
    """Takes branches and repositories that are not in ``heads`` out of ``tables``; the parts these fill then."""
    keep = cut_lineage(heads.select("repo_id").distinct())
    stamped = stored(spark, store, "repo_branches").select("repo_id", "branch")
    gone = cut_lineage(stamped.join(heads, ["repo_id", "branch"], "left_anti"))
    leaving = cut_lineage(tables["repos"].select(F.col("id").alias("repo_id")).join(keep, "repo_id", "left_anti"))
    n_leaving, n_all = leaving.count(), tables["repos"].count()
    if not idx.may_purge(n_all, n_leaving):
        gone, leaving, n_leaving = gone.join(leaving, "repo_id", "left_anti"), leaving.limit(0), 0
    report.retired, report.purged = gone.count(), n_leaving
    if not report.retired and not report.purged:
        return buckets
    more = {r[0] for r in gone.select("repo_id").unionByName(leaving).select(store.bucket(F.col("repo_id"))).distinct().collect()} - buckets
    if more:
        for t in ("files", "repo_branches", *CHILDREN):
            tables[t] = tables[t].unionByName(stored(spark, store, t, more))
    tables["files"], tables["repo_branches"] = idx.retire(tables["files"], tables["repo_branches"], gone)
    if n_leaving:
        for t in ("files", *CHILDREN, "repo_branches"):
            tables[t] = tables[t].join(F.broadcast(leaving), "repo_id", "left_anti")
        tables["repos"] = tables["repos"].join(F.broadcast(leaving.withColumnRenamed("repo_id", "id")), "id", "left_anti")
    alive = tables["files"].select("id")
    for t in CHILDREN:
        tables[t] = idx.cascade(tables[t], alive)
    return buckets | more
