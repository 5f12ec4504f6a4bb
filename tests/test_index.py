"""Snapshots into the store: archives, filters, classes of files, sweeps, guards, versions and streams."""

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from sourcelume.functions.chunks import chunk_text, embed_chunks, hash_embedder
from sourcelume.functions.text import byte_offset, content_sha, cosine, glob_pattern, merge_spans
from sourcelume.operators import index as idx
from sourcelume.sources.archives import BadArchive, check_link, read_archives, read_tree, safe_name, scan_archive
from sourcelume.sources.listing import ConfigError, check_ceiling, choose_branches, choose_repos, collect_pages, matches_glob, parse_config, rate_limited, repo_slug
from sourcelume.sources.snapshots import SnapshotStore, StaleSnapshot
from sourcelume.streaming.incremental import apply_batch, event_counts, index_stream


def archive(files, links=(), top="repo-abc"):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name, data in files:
            t = tarfile.TarInfo(f"{top}/{name}" if top else name)
            t.size = len(data)
            tar.addfile(t, io.BytesIO(data))
        for name, target in links:
            t = tarfile.TarInfo(f"{top}/{name}")
            t.type, t.linkname = tarfile.SYMTYPE, target
            tar.addfile(t)
    return raw.getvalue()


def test_archive_filters():
    files = [("b.py", b"x = 1\n"), ("a.go", b"a\0b"), (".git/config", b"x"), ("bin.py", b"\xff\xfe"), ("late.txt", b"y" * 9000 + b"\0z"), ("big.py", b"z" * 1_000_001), ("b.py", b"second"), ("q/C.JAVA", b"")]
    got = [(f.path, f.lang, f.size, f.content) for f in scan_archive(archive(files, [("ln", "b.py")]))]
    assert [g[:3] for g in got] == [("b.py", "python", 6), ("late.txt", None, 9002), ("q/C.JAVA", "java", 0)]
    assert got[1][3] == "y" * 9000 + "z" and got[0][3] == "x = 1\n"


@pytest.mark.parametrize(
    "raw",
    [archive([("../x", b"a")]), archive([("/etc/x", b"a")], top=""), archive([("a", b"1")], [("l", "../../x")]), archive([("a", b"1")], [("l", "/etc/x")]), archive([("x" * 40 + str(i), os.urandom(3000)) for i in range(9)])[:-2000], b"no archive", archive([("one/a", b"1"), ("two/b", b"2")], top="")[:0], archive([])],
)
def test_bad_archives(raw):
    with pytest.raises(BadArchive):
        list(scan_archive(raw))


def test_archive_limits_and_tops():
    with pytest.raises(BadArchive):
        list(scan_archive(archive([("a", b"x" * 5000)]), most=1000))
    with pytest.raises(BadArchive):
        list(scan_archive(archive([("one/a", b"1"), ("two/b", b"2")], top="")))
    assert safe_name("././a/b") == "a/b"
    check_link("top/a/b", "../c")


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.tar.gz").write_bytes(archive([("b.py", b"x"), ("a.go", b"y")]))
    (tmp_path / "in" / "bad.tar.gz").write_bytes(b"nothing")
    rows = read_archives(spark, str(tmp_path / "in")).collect()
    assert sorted((r["ord"], r["path"]) for r in rows if r["error"] is None) == [(0, "b.py"), (1, "a.go")] and sum(r["error"] is not None for r in rows) == 1
    tree = tmp_path / "tree"
    for name, data in (("a/b.py", b"x = 1"), ("a/.git/c", b"x"), ("bin", b"a\0b"), ("bad.txt", b"\xff\xfe")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    assert [(r["path"], r["lang"], r["size"], r["content"]) for r in read_tree(spark, str(tree)).collect()] == [("a/b.py", "python", 5, "x = 1")]


def test_chunks(spark):
    assert chunk_text("") == [] and chunk_text("a\nb\n", 3) == [(0, "a\n", 1, 1), (1, "b\n", 2, 2)] and chunk_text("x" * 9 + "\ny", 4) == [(0, "x" * 9 + "\n", 1, 1), (1, "y", 2, 2)]
    text = "".join(f"line {i}\r\n" for i in range(400)) + "a\x0cb c"
    cs = chunk_text(text)
    assert "".join(c[1] for c in cs) == text and cs[-1][3] == len(text.splitlines()) and all(len(c[1]) <= 2000 for c in cs) and all(a[3] + 1 == b[2] for a, b in zip(cs, cs[1:]))
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, content string")
    out = {r["id"]: r["embedding"] for r in embed_chunks(df, hash_embedder(8), 8).collect()}
    assert len(out[1]) == 8 and abs(sum(x * x for x in out[1]) - 1) < 1e-5 and sum(out[2]) == 0
    with pytest.raises(Exception, match="another number or size"):
        embed_chunks(df, lambda t: [[0.0]] * len(t), 8).collect()


FILES = "id long, repo_id int, path string, lang string, size int, content string, commit string, content_sha string, branches array<string>"
NEW = "repo_id int, branch string, path string, lang string, size int, content string, commit string, ord long"


def snap(spark, rows):
    return idx.stamp_contents(spark.createDataFrame([(1, b, p, "python", len(c), c, "c", i) for i, (b, p, c) in enumerate(rows)], NEW))


def state(df):
    return {(r["path"], r["content"]): tuple(r["branches"]) for r in df.collect()}


def test_index_scenarios(spark):
    files = spark.createDataFrame([], FILES)
    first = snap(spark, [("main", "a.py", "A"), ("main", "u.py", "U"), ("main", "a.py", "A")])
    files = spark.createDataFrame(idx.sweep(idx.merge_files(files, first), first).collect(), FILES)
    assert state(files) == {("a.py", "A"): ("main",), ("u.py", "U"): ("main",)}
    ids = {r["path"]: r["id"] for r in files.collect()}
    again = spark.createDataFrame(idx.sweep(idx.merge_files(files, first), first).collect(), FILES)
    assert state(again) == state(files) and {r["path"]: r["id"] for r in again.collect()} == ids
    feature = snap(spark, [("feature", "a.py", "A"), ("feature", "u.py", "V"), ("feature", "f.py", "F")])
    classes = {(r["path"], r["class"]) for r in idx.classify(feature, files).collect()}
    assert classes == {("a.py", "membership"), ("u.py", "changed"), ("f.py", "changed")}
    none = spark.createDataFrame([], "repo_id int")
    S = "repo_id int, branch string, index_semantics_version int"
    for stamped, main, new in (([], "changed", "changed"), ([("main", 3), ("feature", 3)], "carried", "membership"), ([("main", 3), ("feature", 3), ("old", 2)], "carried", "changed"), ([("main", 3), ("feature", None)], "carried", "changed"), ([("main", 2), ("feature", 3)], "changed", "changed")):
        gate = idx.gates(spark.createDataFrame([(1, b, v) for b, v in stamped], S), 3)
        assert {r["class"] for r in idx.classify(first, files, gate).collect()} == {main}, stamped
        assert {r["path"]: r["class"] for r in idx.classify(feature, files, gate).collect()} == {"a.py": new, "u.py": "changed", "f.py": "changed"}, stamped
    assert {r["class"] for r in idx.classify(first, files).collect()} == {"carried"}
    files = spark.createDataFrame(idx.sweep(idx.merge_files(files, feature), feature).collect(), FILES)
    assert state(files) == {("a.py", "A"): ("feature", "main"), ("u.py", "U"): ("main",), ("u.py", "V"): ("feature",), ("f.py", "F"): ("feature",)}
    less = snap(spark, [("main", "a.py", "A")])
    swept = idx.sweep(idx.merge_files(files, less), less)
    assert state(swept) == {("a.py", "A"): ("feature", "main"), ("u.py", "V"): ("feature",), ("f.py", "F"): ("feature",)}
    assert state(idx.sweep(files, less.limit(0))) == state(files)  # an empty snapshot deletes nothing
    stamps = spark.createDataFrame([(1, "main", "c1", 3), (1, "feature", "c2", None)], "repo_id int, branch string, last_indexed_commit string, index_semantics_version int").withColumn("last_indexed_at", F.lit(None).cast("timestamp"))
    left, kept = idx.retire(files, stamps, spark.createDataFrame([(1, "feature"), (1, None), (1, " ")], "repo_id int, branch string"))
    assert state(left) == {("a.py", "A"): ("main",), ("u.py", "U"): ("main",)} and [r["branch"] for r in kept.collect()] == ["main"]
    assert idx.current_repos(stamps, 3).count() == 0 and idx.current_repos(stamps.where("branch = 'main'"), 3).count() == 1
    with pytest.raises(ValueError):
        idx.purge(files, none)
    heads = spark.createDataFrame([(1, "main", "c1"), (1, "feature", "c2"), (2, "x", "c")], "repo_id int, branch string, commit string")
    assert {r["branch"] for r in idx.work_list(heads, stamps, 3).collect()} == {"feature", "x"}
    done = spark.createDataFrame([(1, "feature", "c9", 0), (3, "main", "c", 5), (1, "main", "c5", 2)], "repo_id int, branch string, commit string, parsed int")
    after = {(r["repo_id"], r["branch"]): (r["last_indexed_commit"], r["index_semantics_version"]) for r in idx.next_stamps(stamps, done, 4).collect()}
    assert after == {(1, "feature"): ("c9", None), (3, "main"): ("c", 4), (1, "main"): ("c5", 4)}
    kids = spark.createDataFrame([(10, 1), (11, 2)], "id int, file_id long")
    assert idx.cascade(kids, spark.createDataFrame([(2,)], "id long")).count() == 1
    assert {r["id"] for r in idx.replace_children(kids, spark.createDataFrame([(12, 2)], "id int, file_id long"), spark.createDataFrame([(2,)], "id long")).collect()} == {10, 12}


def test_guards():
    assert idx.may_purge(10, 5) and not idx.may_purge(10, 6)
    assert idx.RunOutcome().may_reconcile and not idx.RunOutcome(failures=1).may_reconcile and not idx.RunOutcome(all_complete=False).may_reconcile


def test_snapshots(spark, tmp_path):
    from sourcelume.sources.snapshots import HadoopFiles

    one = spark.createDataFrame([(1,)], "x int")
    for store in (SnapshotStore(str(tmp_path / "store")), SnapshotStore("file://" + str(tmp_path / "hadoop"), files=HadoopFiles(spark))):
        assert store.version() == 0 and store.commit({"a": one, "b": one}, 0) == 1 and store.commit({"a": one.union(one)}, 1) == 2
        assert store.read(spark, "a").count() == 2 and store.read(spark, "b").count() == 1 and store.read(spark, "a", 1).count() == 1
        with pytest.raises(StaleSnapshot):
            store.commit({"a": one}, 1)
        with pytest.raises(Exception):
            store.commit({"a": one.select(F.raise_error(F.lit("broken")).alias("y"))}, 2)
        assert store.version() == 2 and store.commit({"a": one}, 2) == 3


def test_two_writers_one_version(spark, tmp_path):
    """Of two runs that start from one version just one commits, whatever the order of their steps; the other's data is gone
    and what the first wrote is whole."""
    import threading

    from sourcelume.sources.snapshots import LocalFiles

    class Slow(LocalFiles):
        """Both have written their data before either claims."""

        gate = threading.Barrier(2, timeout=60)

        def claim(self, path, text):
            self.gate.wait()
            return super().claim(path, text)

    root = str(tmp_path / "store")
    SnapshotStore(root).commit({"t": spark.createDataFrame([(1, 0)], "repo_id int, x int")}, 0)
    results = {}

    def write(n):
        df = spark.createDataFrame([(1, n), (2, n), (3, n)], "repo_id int, x int")
        try:
            results[n] = SnapshotStore(root, files=Slow()).commit({"t": df}, 1)
        except StaleSnapshot:
            results[n] = None

    threads = [threading.Thread(target=write, args=(n,)) for n in (7, 8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, v in results.items() if v == 2]
    store = SnapshotStore(root)
    assert len(won) == 1 and sorted(results.values(), key=str) == [2, None] and store.version() == 2
    assert {r["x"] for r in store.read(spark, "t").collect()} == {won[0]} and store.read(spark, "t").count() == 3
    assert len(os.listdir(os.path.join(root, "data"))) == 2


def test_parts(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"), buckets=8)
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "repo_id int, v string")
    store.commit({"t": rows}, 0)
    part = store.read(spark, "t", buckets=[3])
    mine = {r["repo_id"] for r in part.collect()}
    assert mine and mine == {r["repo_id"] for r in rows.where(store.bucket(F.col("repo_id")) == 3).collect()}
    before = store.manifest()["tables"]["t"]["parts"]
    store.commit({"t": part.withColumn("v", F.lit("new")).limit(1)}, 1, buckets=[3])
    after = store.manifest()["tables"]["t"]["parts"]
    assert {b for b in before if before[b] != after.get(b)} == {"3"} and store.read(spark, "t").count() == 40 - len(mine) + 1
    with pytest.raises(ValueError):
        store.commit({"t": rows}, 2, buckets=[3])
    store.commit({"t": rows.limit(0)}, 2, buckets=[3])
    assert store.read(spark, "t", buckets=[3]).count() == 0 and store.read(spark, "t").count() == 40 - len(mine)


def test_contents_do_not_move(spark, tmp_path):
    """A merge of few rows into many: the stored contents are read and written, not shuffled."""
    files = spark.range(1000).selectExpr("id", "cast(id % 7 as int) repo_id", "concat('p', id) path", "'python' lang", "1 size", "repeat('x', 100) content", "'c' commit", "sha2(cast(id as string), 256) content_sha", "array('main') branches")
    files.write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    new = snap(spark, [("main", "a.py", "A")])
    out = idx.apply_changes(stored, new, idx.file_changes(stored, new, False))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    scan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in scan and "SortMergeJoin" not in scan and out.count() == 1001 and "full" not in plan.lower()


D = "repo string, branch string, ord long, path string, lang string, size int, content string, error string"
H = "repo string, default_branch string, branch string, commit string"


def deliver(spark, rows):
    return spark.createDataFrame([(r, b, i, p, "python" if p else None, len(c or ""), c, e) for i, (r, b, p, c, e) in enumerate(rows)], D)


def test_index_run(spark, tmp_path):
    """From deliveries to all six tables: new, repeated, moved and failing branches, retired ones and purged repositories."""
    from sourcelume.operators.run import Rules, run, stored, stored_corpus

    store = SnapshotStore(str(tmp_path / "s"), buckets=4)
    code = "import os\n\ndef alpha():\n    return os.path.join('a')\n"
    wanted = [("o/a", "main", "main", "c1"), ("o/a", "main", "dev", "c2"), ("o/b", None, "HEAD", "c3"), ("o/c", "main", "main", "c4")]
    rows = [("o/a", "main", "a.py", code, None), ("o/a", "main", "u.py", "x = 1\n", None), ("o/a", "dev", "a.py", code, None), ("o/a", "dev", "new.py", "def beta():\n    alpha()\n", None), ("o/b", "HEAD", "a.py", code, None), ("o/c", "main", None, None, "unreadable")]

    def go(rows, wanted, **kw):
        return run(spark, store, deliver(spark, rows), spark.createDataFrame(wanted, H), **kw)

    def table(name):
        return stored(spark, store, name).collect()

    report = go(rows, wanted)
    ids = {r["name"]: r["id"] for r in table("repos")}
    assert sorted(ids) == ["o/a", "o/b", "o/c"] and sorted(ids.values()) == [1, 2, 3]
    assert [(s[0], s[1], s[2], s[4]) for s in report.status] == [(ids["o/a"], "dev", 2, "indexed"), (ids["o/a"], "main", 2, "indexed"), (ids["o/b"], "HEAD", 1, "indexed"), (ids["o/c"], "main", 0, "failed")]
    assert report.counts == {"changed": 5} and report.version == 1 and report.retired == 0
    files = {(r["repo_id"], r["path"]): tuple(r["branches"]) for r in table("files")}
    assert files == {(ids["o/a"], "a.py"): ("dev", "main"), (ids["o/a"], "u.py"): ("main",), (ids["o/a"], "new.py"): ("dev",), (ids["o/b"], "a.py"): ("HEAD",)}
    assert sorted(r["name"] for r in table("symbols")) == ["alpha", "alpha", "beta"] and {r["target_name"] for r in table("reference_edges")} >= {"os", "alpha"}
    assert len(table("chunks")) == 4 and all(len(r["embedding"]) == 128 for r in table("chunks")) and any("'alpha'" in r["ts"] for r in table("chunks"))
    assert {(r["repo_id"], r["branch"]): (r["last_indexed_commit"], r["index_semantics_version"]) for r in table("repo_branches")} == {(ids["o/a"], "main"): ("c1", 1), (ids["o/a"], "dev"): ("c2", 1), (ids["o/b"], "HEAD"): ("c3", 1)}
    assert {r["name"]: r["last_indexed_commit"] for r in table("repos")} == {"o/a": "c1", "o/b": "c3", "o/c": None}
    corpus = stored_corpus(spark, store)
    from sourcelume.operators.grep import grep
    from sourcelume.operators.semantic import hybrid

    assert {r["path"] for r in grep(corpus, "repo:o/a alpha").collect()} == {"a.py"}
    assert hybrid(corpus, [1.0] + [0.0] * 127, ["alpha"]).count() >= 1

    # main moves on, dev gets what main had, c comes, and b is no longer wanted: retired only after a clean run
    wanted = [("o/a", "main", "main", "c5"), ("o/a", "main", "dev", "c6"), ("o/c", "main", "main", "c4")]
    rows = [("o/a", "main", "a.py", code, None), ("o/a", "dev", "a.py", code, None), ("o/a", "dev", "u.py", "x = 1\n", None), ("o/c", "main", "z.py", "y = 2\n", None)]
    report = go(rows, wanted)
    assert report.counts == {"carried": 2, "membership": 1, "changed": 1} and report.purged == 1 and report.retired == 1
    files = {(r["repo_id"], r["path"]): tuple(r["branches"]) for r in table("files")}
    assert files == {(ids["o/a"], "a.py"): ("dev", "main"), (ids["o/a"], "u.py"): ("dev",), (ids["o/c"], "z.py"): ("main",)}
    alive = {r["id"] for r in table("files")}
    assert all({r["file_id"] for r in table(t)} <= alive for t in ("symbols", "reference_edges", "chunks")) and {r["name"] for r in table("repos")} == {"o/a", "o/c"}

    # other rules: all is done anew, ids stay; a branch without indexable files keeps its rows and its old rules
    report = go([("o/a", "dev", "a.py", code, None), ("o/a", "main", None, None, None), ("o/c", "main", "z.py", "y = 2\n", None)], wanted, rules=Rules(version=2, most_chunks=0))
    assert report.counts == {"changed": 2} and {r["id"] for r in table("files")} < alive and sorted(d[1] for d in report.degraded) == ["dev", "main"]
    assert {(r["repo_id"], r["branch"]): r["index_semantics_version"] for r in table("repo_branches")} == {(ids["o/a"], "main"): 1, (ids["o/a"], "dev"): 2, (ids["o/c"], "main"): 2}

    # another run commits in between
    class Raced(SnapshotStore):
        def commit(self, tables, expected, *a, **k):
            SnapshotStore.commit(self, {"other": spark.range(1)}, expected)
            return super().commit(tables, expected, *a, **k)

    with pytest.raises(StaleSnapshot):
        run(spark, Raced(str(tmp_path / "s")), deliver(spark, [("o/d", "main", "e.py", "e = 1\n", None)]), spark.createDataFrame([("o/d", "main", "main", "c10")], H))
    # it had found that it would leave less than half of the repositories, and would have purged none
    assert "e.py" not in {r["path"] for r in table("files")}


def test_stream(spark, tmp_path):
    store, src = SnapshotStore(str(tmp_path / "s")), str(tmp_path / "in")
    row = lambda p, c: [(1, "main", p, "python", 1, c, "c", 1)]
    spark.createDataFrame(row("a.py", "A"), NEW).write.parquet(src)
    index_stream(spark, src, store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.version() == 1 and state(store.read(spark, "files")) == {("a.py", "A"): ("main",)}
    assert store.read(spark, "chunks").count() == 1 and store.read(spark, "repo_branches").first()["last_indexed_commit"] == "c"
    spark.createDataFrame(row("b.py", "B"), NEW).write.mode("append").parquet(src)
    index_stream(spark, src, store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.version() == 2 and state(store.read(spark, "files")) == {("b.py", "B"): ("main",)}
    assert {r["file_id"] for r in store.read(spark, "chunks").collect()} == {r["id"] for r in store.read(spark, "files").collect()}
    assert apply_batch(store, spark.createDataFrame(row("z.py", "Z"), NEW), 1) == 2  # delivered again: nothing happens
    ev = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.5D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2D")
    assert [(r["n"], r["total"]) for r in event_counts(ev).collect()] == [(2, 3.5)]


def test_listing(spark):
    c = parse_config(b"orgs: [a]\nrepos:\n  - x/y\n  - {name: 'https://h/o/r.git', branches: ['rel-*']}\nexclude: ['*/old']\n")
    assert c.orgs == ("a",) and [r.name for r in c.repos] == ["x/y", "o/r"] and parse_config(b"").repos == ()
    for bad in (b"- a", b"orgs: x", b"\xff", b"a: [", b"repos: [{}]", b"skip_forks: 'false'", b"unknown: 1", b"repos: [{name: a/b, more: 1}]", b"repos: {a: 1}", b"repos: [{name: a/b, branches: x}]"):
        with pytest.raises(ConfigError):
            parse_config(bad)
    assert repo_slug("git@h:o/r.git") == "o/r" and matches_glob("o/r", "o/*") and not matches_glob("O/r", "o/*")
    pages = {"1": ([{"n": 1}], "2"), "2": ([{"n": 2}], None)}
    assert collect_pages(lambda u: pages[u], "1") == [{"n": 1}, {"n": 2}]
    with pytest.raises(ConfigError):
        collect_pages(lambda u: ([], u), "1")
    assert rate_limited(429, {}) and rate_limited(403, {"Retry-After": "1"}) and rate_limited(403, {"X-RateLimit-Remaining": "0"}) and not rate_limited(403, {})
    rows = [("o/A", 1, False, False, ["m"]), ("O/a", 2, False, False, ["r"]), ("o/fork", 3, True, False, []), ("o/old", 4, False, True, []), ("o/x.y", 5, False, False, [])]
    listed = spark.createDataFrame(rows, "name string, ord int, fork boolean, archived boolean, branches array<string>")
    kept, dropped = choose_repos(listed, ["*.y"], True, True)
    assert {(r["name"], tuple(r["branches"])) for r in kept.collect()} == {("o/A", ("m", "r"))} and {(r["reason"], r["n"]) for r in dropped.collect()} == {("fork", 1), ("archived", 1), ("exclude:*.y", 1)}
    with pytest.raises(ConfigError):
        check_ceiling(listed, 4)
    b = spark.createDataFrame([(1, x, "main") for x in ("main", "r1", "r2", "z")] + [(2, "HEAD", None)], "repo_id int, branch string, default_branch string")
    assert {(r["repo_id"], r["branch"], r["complete"]) for r in choose_branches(b, ["r*"], 2).collect()} == {(1, "main", False), (1, "r1", False), (2, "HEAD", True)}


def test_expressions(spark):
    df = spark.sql("SELECT array(array(5, 7), array(0, 2), array(2, 3), array(6, 9), array(4, 4)) AS s, '你好x' AS t, array(1F, 0F) AS a, array(0F, 0F) AS z")
    r = df.select(merge_spans(F.col("s")).alias("m"), byte_offset(F.col("t"), F.lit(2)).alias("b"), content_sha(F.lit(None)).alias("h"), cosine(F.col("a"), F.col("a")).alias("one"), cosine(F.col("a"), F.col("z")).alias("none")).first()
    assert [list(x) for x in r["m"]] == [[0, 3], [5, 9]] and r["b"] == 6 and r["h"].startswith("e3b0c442") and r["one"] == 1.0 and r["none"] is None
    names = spark.createDataFrame([("o/a.b",), ("o/aXb",), ("p/[x]",)], "n string")
    assert [r["n"] for r in names.where(F.col("n").rlike(glob_pattern("o/a.?"))).collect()] == ["o/a.b"] and names.where(F.col("n").rlike(glob_pattern("[!o]/*"))).count() == 1


def test_reports_and_downloads(spark, tmp_path):
    d = spark.createDataFrame([(1, "main", "a", None), (1, "main", "b", None), (2, "main", None, "unreadable")], "repo_id int, branch string, path string, error string")
    w = spark.createDataFrame([(1, "main"), (2, "main"), (3, "x"), (1, "main")], "repo_id int, branch string")
    report = idx.run_report(d, w)
    assert {(r["repo_id"], r["files"], r["status"]) for r in report.collect()} == {(1, 2, "indexed"), (2, 0, "failed"), (3, 0, "missing")}
    assert not idx.outcome(report).may_reconcile and idx.outcome(report.where("status = 'indexed'")).may_reconcile
    files = spark.createDataFrame([(1, 7, ["m", "n"]), (2, 7, ["m"])], "id int, repo_id int, branches array<string>")
    chunks = spark.createDataFrame([(1,), (1,), (2,)], "file_id int")
    assert [(r["branch"], r["chunks"]) for r in idx.degraded_branches(chunks, files, 2).collect()] == [("m", 3)]
    from sourcelume.sources.listing import Unavailable, check_headroom, download, resolve_heads

    target = str(tmp_path / "x.tar.gz")
    assert download(lambda u: [b"ab", b"c"], "u", target) == 3 and open(target, "rb").read() == b"abc"
    with pytest.raises(Unavailable):
        download(lambda u: [b"abc"], "u", str(tmp_path / "y"), most=2)
    assert sorted(os.listdir(tmp_path)) == ["x.tar.gz"]
    check_headroom(str(tmp_path), 1)
    with pytest.raises(Unavailable):
        check_headroom(str(tmp_path), 10**18)
    assert list(resolve_heads(["r"], lambda r, b: ("main", f"{b}-sha"), lambda r: ["main", "dev"])) == [("r", "main", "main", "main-sha"), ("r", "main", "dev", "dev-sha")]


def test_trigrams(spark, tmp_path):
    from sourcelume.operators import trigrams as tri

    rows = [(1, "Hello sorted(x)"), (2, "ab"), (3, None), (4, "unsorted list"), (5, "")]
    table = tri.build(spark.createDataFrame(rows, "id int, content string"))
    tri.write(table, str(tmp_path / "t"), 3)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert {r["file_id"] for r in tri.candidates(stored, "SORTED").collect()} == {1, 4} and {r["file_id"] for r in tri.candidates(stored, "sorted(").collect()} == {1}
    assert tri.candidates(stored, "ab") is None and tri.candidates(stored, "zzz").count() == 0


def test_search_vectors(spark):
    from sourcelume.functions.search_vector import search_vector, stem, vector_text

    stems = {"running": "run", "flies": "fli", "relational": "relat", "hopping": "hop", "hoping": "hope", "happiness": "happi", "generously": "generous", "controlling": "control", "skies": "sky", "agreed": "agre", "communism": "communism", "knightly": "knight", "news": "news", "x2": "x2", "日本": "日本"}
    assert {w: stem(w) for w in stems} == stems
    assert vector_text("The Quick fox's foxes jumped, quickly QUICK") == "'fox':3,4 'jump':5 'quick':2,6,7" and vector_text("") == "" and vector_text("the of it") == ""
    rows = spark.createDataFrame([("snake_case names",), (None,)], "t string")
    assert [r["v"] for r in rows.select(search_vector(rows["t"]).alias("v")).collect()] == ["'case':2 'name':3 'snake':1", None]


def test_union_of_listings(spark):
    from sourcelume.sources.listing import RateLimited, list_branches, list_wanted, page_fetcher, read_config

    pages = {
        "org/o?1": (200, {"Link": '<org/o?2>; rel="next", <org/o?9>; rel="last"'}, [{"full_name": "o/a", "fork": False}, {"full_name": "o/f", "fork": True}]),
        "org/o?2": (200, {}, [{"full_name": "o/old", "archived": True}, {"full_name": "o/x-test"}]),
        "user/u?1": (200, {}, [{"full_name": "O/A"}, {"full_name": "u/own"}]),
        "heads/o/a": (200, {}, [{"name": "main", "commit": "c1"}, {"name": "rel-2", "commit": "c2"}, {"name": "rel-1", "commit": "c3"}, {"name": "z", "commit": "c4"}]),
        "busy": (403, {"Retry-After": "7"}, None), "gone": (500, {}, None),
    }
    fetch = page_fetcher(lambda u: pages[u])
    status, config, _ = read_config(lambda: b"orgs: [o]\nusers: [u]\nrepos: [{name: o/f, branches: ['rel-*']}, n/named]\nexclude: ['*-test']\nskip_forks: true\nskip_archived: true\n")
    assert status == "ok"
    kept, dropped = list_wanted(spark, config, fetch, lambda kind, name: f"{kind}/{name}?1")
    got = {r["name"]: tuple(r["branches"]) for r in kept.collect()}
    assert got == {"o/a": (), "u/own": (), "o/f": ("rel-*",), "n/named": ()} and {(r["reason"], r["n"]) for r in dropped.collect()} == {("archived", 1), ("exclude:*-test", 1)}
    one = spark.createDataFrame([("o/a", ["rel-*"])], "name string, branches array<string>")
    rows = list_branches(spark, one, fetch, lambda n: f"heads/{n}", lambda r, b: ("main", "c1"), most=2).collect()
    assert [(r["branch"], r["commit"], r["complete"]) for r in rows] == [("main", "c1", False), ("rel-1", "c3", False)]
    with pytest.raises(RateLimited) as e:
        fetch("busy")
    assert e.value.retry_after == 7
    with pytest.raises(ConfigError):
        fetch("gone")
    assert read_config(lambda: None)[0] == "missing" and read_config(lambda: b"a: [")[0] == "invalid"

    def broken():
        raise PermissionError("no")

    assert read_config(broken)[0] == "unreadable"


def test_narrowing(spark):
    from sourcelume.operators import trigrams as tri
    from sourcelume.plans.language import parse
    from sourcelume.plans.narrow import candidates_of, required_literals

    assert required_literals("foo.*barbaz") == ["foo", "barbaz"] and required_literals("a(bcd)+e|x") == [] and required_literals("ab(cd)ef[gh]") == ["abcdef"] and required_literals("(?:abc)?defg") == ["defg"] and required_literals("(") == [] and required_literals("x(abc){2}y") == ["abc"]
    rows = [(1, "alpha beta"), (2, "alpha gamma"), (3, "beta gamma"), (4, None)]
    table = tri.build(spark.createDataFrame(rows, "id int, content string"))
    got = lambda q: (lambda d: d if d is None else {r[0] for r in d.collect()})(candidates_of(table, parse(q)))
    assert got("alpha") == {1, 2} and got("alpha beta") == {1} and got("alpha or gamma") == {1, 2, 3} and got("-alpha") is None and got("alpha -beta") == {1, 2}
    assert got("al") is None and got("alpha or lang:go") is None and got("lang:go alpha") == {1, 2} and got("/alp.*amma/") == {2} and got("/a.b/") is None


def test_migrations(spark, tmp_path):
    from sourcelume.operators.migrate import CannotMigrate, migrate

    store = SnapshotStore(str(tmp_path / "s"))
    repos = spark.createDataFrame([(1, "o/a", None, "c1", 3), (2, "o/b", "dev", None, None)], "id int, name string, default_branch string, last_indexed_commit string, index_semantics_version int").withColumn("last_indexed_at", F.lit(None).cast("timestamp"))
    old = spark.createDataFrame([(1, 1, "a.py", "A"), (2, 2, "b.py", None), (3, 9, "c.py", "C")], "id int, repo_id int, path string, content string")
    store.commit({"repos": repos, "files": old}, 0)
    assert migrate(spark, store) == [2] and migrate(spark, store) == [] and store.version() == 2
    rows = {r["id"]: (r["branches"], r["content_sha"][:6]) for r in store.read(spark, "files").collect()}
    assert rows == {1: (["HEAD"], "559aea"), 2: (["dev"], "e3b0c4"), 3: (None, "6b23c0")}
    assert {(r["repo_id"], r["branch"], r["last_indexed_commit"]) for r in store.read(spark, "repo_branches").collect()} == {(1, "HEAD", "c1"), (2, "dev", None)}
    twice = store.read(spark, "files").unionByName(store.read(spark, "files").where("id = 1").withColumn("content_sha", F.lit("other")))
    store.commit({"files": twice}, 2)
    with pytest.raises(CannotMigrate):
        migrate(spark, store, 1)
    assert store.version() == 3
    store.commit({"files": store.read(spark, "files", 2)}, 3)
    assert migrate(spark, store, 1) == [1] and set(store.read(spark, "files").columns) == {"id", "repo_id", "path", "content"} and migrate(spark, store) == [2]
