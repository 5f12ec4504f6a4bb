"""Seeded corpora: which files a query selects, which lines it shows, which symbols and references answer."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sourcelume.operators import references as ref
from sourcelume.operators.grep import Matchers, grep, line_spans, within_bytes
from sourcelume.operators.search import commit_mood, file_lines, get_file, list_repos, merged_files, permalink_branch, resolve_commits
from sourcelume.operators.symbols import find_symbols
from sourcelume.plans.corpus import Corpus, page, select_files
from sourcelume.plans.language import case_of, parse
from sourcelume.service import BadCursor, Limits, Service, decode_cursor, encode_cursor

#: A first statement compiles and starts workers; what is tested is not how long that takes.
PATIENT = Limits(statement_s=60.0, match_s=60.0)
GO = "package main\n\nfunc Handler() {}\n// Handler processes an incoming Request via parseRequest\n"
FILES = [
    ("acme/widgets", "src/handler.go", "go", GO, ["main"]), ("acme/widgets", "src/util.go", "go", "package main\n\nfunc helperFn() {}\n// generic handler utility, not exported\n", ["main"]),
    ("acme/widgets", "src/escape1.go", "go", "token foo_bar here", ["main"]), ("acme/widgets", "src/escape2.go", "go", "token fooXbar here", ["main"]), ("acme/widgets", "src/regex_lower.go", "go", "alpha fooXXXbar beta", ["main"]),
    ("acme/widgets", "SRC/UpperCase.go", "go", "case sensitivity path marker only", ["main"]), ("acme/widgets", "src/no_lang.txt", None, "handler mention with no lang set", ["main"]),
    ("beta/tools", "pkg/regex_upper.py", "python", "alpha FooXXXBar beta", ["main"]), ("beta/tools", "pkg/handler_note.py", "python", "# handler mentioned here in beta too", ["main"]), ("gamma/misc", "gamma/null_content.txt", None, None, ["main"]),
    ("branch/main-default", "src/default_only.go", "go", "on main only", ["main"]), ("branch/main-default", "src/shared.go", "go", "same content on both branches", ["main", "feature"]),
    ("branch/main-default", "src/divergent.go", "go", "main version", ["main"]), ("branch/main-default", "src/divergent.go", "go", "feature version", ["feature"]), ("branch/null-default", "src/head_file.go", "go", "on head", ["HEAD"]),
    ("crlf/x", "你好.txt", None, "// 你好 foo trailing\r\nno match\r\nfoo foo\n", ["main"]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    names = sorted({f[0] for f in FILES})
    ids = {n: i + 1 for i, n in enumerate(names)}
    repos = [(ids[n], n, None if n == "branch/null-default" else "main", None, None, None) for n in names]
    files = [(i + 1, ids[r], p, lang, len(c or ""), c, None, hashlib.sha256((c or "").encode()).hexdigest(), b) for i, (r, p, lang, c, b) in enumerate(FILES)]
    symbols = [(1, 1, ids["acme/widgets"], "Handler", "function", 3, 3), (2, 1, ids["acme/widgets"], "parseRequest", "function", None, None), (3, 2, ids["acme/widgets"], "helperFn", "function", 3, 3), (4, 9, ids["beta/tools"], "dup", "type", 1, 1), (5, 2, ids["acme/widgets"], "dup", "function", 4, 4), (5, 2, ids["acme/widgets"], "dup", "function", 4, 4)]
    edges = [(1, ids["acme/widgets"], 1, "call", "helperFn", 3, "Handler", "function", 3, 3), (2, ids["acme/widgets"], 2, "call", "dup", 5, None, None, None, None), (2, ids["acme/widgets"], 2, "call", "dup", 5, None, None, None, None), (3, ids["beta/tools"], 9, "call", "missing", 1, None, None, None, None), (4, ids["beta/tools"], 9, "import", "os.path", 1, None, None, None, None)]
    heads = [(1, ids["branch/main-default"], "main", "aaaaaa1" + "0" * 33, 1, None), (2, ids["branch/main-default"], "feature", "BBBBBB2" + "9" * 33, None, None), (3, ids["acme/widgets"], "main", None, None, None)]
    return Corpus(
        spark.createDataFrame(repos, "id int, name string, default_branch string, last_indexed_commit string, last_indexed_at timestamp, index_semantics_version int"),
        spark.createDataFrame(files, "id int, repo_id int, path string, lang string, size int, content string, commit string, content_sha string, branches array<string>"),
        spark.createDataFrame(symbols, "id int, file_id int, repo_id int, name string, kind string, start_line int, end_line int"),
        spark.createDataFrame(edges, "id long, repo_id int, file_id int, edge_kind string, target_name string, line int, enclosing_name string, enclosing_kind string, enclosing_start_line int, enclosing_end_line int"),
        spark.createDataFrame(heads, "id int, repo_id int, branch string, last_indexed_commit string, index_semantics_version int, last_indexed_at timestamp"),
        spark.createDataFrame([(1, 1, 0, "x", 1, 1, [1.0, 0.0], "'handler':1")], "id long, file_id int, chunk_index int, content string, start_line int, end_line int, embedding array<float>, ts string"),
    )


CASES = {
    "handler repo:/^(acme|beta)/": {"handler.go", "util.go", "no_lang.txt", "handler_note.py"}, "case:yes Handler": {"handler.go"}, "/foo.*bar/": {"escape1.go", "escape2.go", "regex_lower.go", "regex_upper.py"},
    "case:yes /foo.*bar/": {"escape1.go", "escape2.go", "regex_lower.go"}, "file:^pkg/": {"regex_upper.py", "handler_note.py"}, "lang:cobol": set(), "sym:Handler": {"handler.go"}, "handler lang:go": {"handler.go", "util.go"},
    "repo:^acme (handler OR foo_bar)": {"handler.go", "util.go", "no_lang.txt", "escape1.go"}, "foo_bar": {"escape1.go"}, "repo:^acme lang:go -handler": {"escape1.go", "escape2.go", "regex_lower.go", "UpperCase.go"}, "repo:^acme -lang:go": set(),
    "file:^gamma/": {"null_content.txt"}, "file:^gamma/ foo": set(), "file:^gamma/ -foo": set(), "repo:^branch/main-default": {"default_only.go", "shared.go", "divergent.go"}, "repo:^branch/main-default branch:feature": {"shared.go", "divergent.go"},
    "repo:^branch/main-default -branch:feature": {"default_only.go", "divergent.go"}, "repo:^branch/null-default": {"head_file.go"}, "commit:bbbbbb2": {"shared.go", "divergent.go"}, "lang:go repo:^branch -commit:aaaaaa1": {"head_file.go"},
}


@pytest.mark.parametrize("query", sorted(CASES))
def test_selected_files(corpus, query):
    rows = select_files(corpus, parse(query), case_of(query)).collect()
    assert sorted(r["path"].split("/")[-1] for r in rows) == sorted(CASES[query])


def test_lines_and_bytes(corpus):
    rows = {(r["line"], r["text"]): r["byte_ranges"] for r in grep(corpus, "foo repo:crlf").collect()}
    assert rows == {(1, "// 你好 foo trailing"): [[10, 13]], (3, "foo foo"): [[0, 3], [4, 7]]}
    assert {r["line"] for r in grep(corpus, "Handler package repo:acme").collect()} >= {1, 3, 4}
    assert grep(corpus, "-foo").count() == 0 and Matchers.of(parse("-foo lang:go")).no_content_atom and Matchers.of(parse("/^/")).zero_width_only and Matchers.of(parse("/[/")).regex_incompatible


def test_span_merging():
    import re

    ps = [re.compile("ab"), re.compile("bc"), re.compile("d"), re.compile("x*")]
    assert line_spans("abcd ab", ps) == [(0, 4), (5, 7)]


def test_symbols(corpus):
    assert {(r["name"], r["start_line"]) for r in find_symbols(corpus, "sym:handler").collect()} == {("Handler", 3)}
    assert find_symbols(corpus, "handler") is None and find_symbols(corpus, "case:yes sym:handler").count() == 0
    m = merged_files(corpus, "sym:Handler parseRequest").collect()
    assert len(m) == 1 and m[0]["match_count"] == 2 and [x["line"] for x in m[0]["matches"]] == [3, 4]


def test_references(corpus):
    got = {r["edge_id"]: (r["candidate_count"], r["resolution"]) for r in ref.resolve(corpus).collect()}
    assert got == {1: (1, "unique"), 2: (2, "ambiguous"), 3: (0, "unresolved"), 4: (0, "unresolved")}
    ranked = ref.ranked_candidates(ref.sites(corpus, target="dup"), corpus).orderBy("candidate_rank").collect()
    assert [r["c_symbol_id"] for r in ranked] == [5, 4] and [r["same_repo"] for r in ranked] == [True, False]
    assert "WindowGroupLimit" in ref.capped_definitions(corpus)._jdf.queryExecution().toString()
    assert ref.resolve(corpus, branch="feature").count() == 0


def test_lists_files_commits(spark, corpus):
    repos = {r["repo"]: (list(r["branches"]), r["default_branch"]) for r in list_repos(corpus).collect()}
    assert repos["branch/main-default"] == (["feature", "main"], "main") and repos["branch/null-default"] == (["HEAD"], "HEAD")
    assert [r["content"] for r in get_file(corpus, "branch/main-default", "src/divergent.go", "feature").collect()] == ["feature version"]
    assert get_file(corpus, "branch/main-default", "nope").count() == 0
    assert {(r["line"], r["text"]) for r in file_lines(corpus.files.where("id = 1"), 3, 1).collect()} == {(3, "func Handler() {}")}
    assert [r["branch"] for r in resolve_commits(corpus, ["bbbbbb2"]).collect()] == ["feature"]
    assert (commit_mood(parse("commit:abcdef0")), commit_mood(parse("commit:abcdef0 x")), commit_mood(parse("x"))) == ("bare", "scoped", "none")
    b = spark.createDataFrame([(["b", "a"],)], "branches array<string>")
    assert b.select(permalink_branch(b["branches"], ["b"]), permalink_branch(b["branches"], ["z"]), permalink_branch(b["branches"], [])).first() == ("b", "a", None)


def test_paging(corpus):
    files = select_files(corpus, parse("repo:^acme lang:go"))
    order = [(r["repo_id"], r["path"], r["content_sha"]) for r in page(files, 100).collect()]
    assert order == sorted(order) and [(r["repo_id"], r["path"], r["content_sha"]) for r in page(files, 2, order[1]).collect()] == order[2:4]
    assert page(files, 0).count() == 0 and "TakeOrderedAndProject" in page(files, 5)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        page(files, -1)
    assert within_bytes(files, 10**6).count() == 6 and within_bytes(files, 0).count() == 0
    assert decode_cursor(encode_cursor(3, "p/é", "s")) == (3, "p/é", "s")
    for bad in ("", "!!", "e30", encode_cursor(True, "p", "s")):
        with pytest.raises(BadCursor):
            decode_cursor(bad)


def test_service(spark, corpus):
    s = Service(spark, corpus, PATIENT)
    out = s.search("handler")
    assert out["file_count"] == 4 and out["match_count"] >= 4 and not out["truncated"] and all("content_sha" not in f for f in out["files"])
    assert s.search("(")["query_parse_error"]["position"] == 1 and s.search("/[[:nope:]]/")["regex_invalid"] and s.search("lang:go")["no_content_atom"] and s.search("commit:1234567")["commit_not_indexed"]
    walked, cursor = [], None
    while True:
        p = s.search("a", limit=3, cursor=cursor, paged=True)
        walked += [(f["repo"], f["file"]) for f in p["files"]]
        cursor = p["next_cursor"]
        if not cursor:
            break
    assert walked == [(f["repo"], f["file"]) for f in s.search("a", limit=1000)["files"]] and len(set(walked)) >= 8
    small = s.search("a", limit=1000, budget=1)
    assert small["truncated"] and len(small["files"]) >= 1
    assert s.search("sym:Handler")["files"][0]["matches"][0]["symbols"][0]["name"] == "Handler"
    assert s.file("acme/widgets", "src/handler.go")["total_lines"] == 5 and not s.file("acme/widgets", "x")["found"]
    assert s.references("helperFn")["summary"]["unique"] == 1 and not s.references("x", repo="no/such")["repo_known"]
    assert "error" in s.imports("sideways") and s.imports("imported_by", target="os.path")["sites"][0]["resolution"] == "unresolved"
    assert s.semantic("sym:x")["unsupported_filter"]["atom"] == "sym:" and s.semantic("repo:a")["nothing_to_embed"]
    two = Service(spark, corpus, PATIENT, embedder=lambda texts: [[1.0, 0.0] for _ in texts])
    assert two.semantic("handler")["results"][0]["similarity"] == 1.0
    assert Limits().clamp(0) == 200 and Limits().clamp(5000) == 1000 and Limits().budget(1) == 1024 and Limits().budget(10**9) == 100_000
    assert len(s.repos()) == 6 and s.ready()


def test_negated_commit_only_excludes(spark, corpus):
    s = Service(spark, corpus, PATIENT)
    plain, without = s.search("a"), s.search("a -commit:bbbbbb2")
    assert plain["file_count"] > 0 and without["file_count"] > 0 and "commit_not_indexed" not in without and "resolved" not in without
    assert s.search("a -commit:1234567")["file_count"] == s.search("a -branch:nowhere")["file_count"] > 0
    assert commit_mood(parse("a -commit:1234567")) == "none" and commit_mood(parse("commit:1234567 -a")) == "scoped"


def test_pages_do_not_lose_twins(spark, corpus):
    first = corpus.files.where("content IS NOT NULL").orderBy("repo_id", "path", "content_sha", "id").limit(1)
    twins = corpus.files.unionByName(first.withColumn("id", F.col("id") + 1000)).unionByName(first.withColumn("id", F.col("id") + 2000))
    c = Corpus(corpus.repos, twins, corpus.symbols, corpus.reference_edges, corpus.repo_branches, corpus.chunks)
    files = twins.withColumn("x", F.lit(1))
    ids, cursor = [], None
    while rows := page(files, 2, cursor).collect():
        ids += [r["id"] for r in rows]
        cursor = tuple(rows[-1][k] for k in ("repo_id", "path", "content_sha", "id"))
    assert sorted(ids) == sorted(r["id"] for r in twins.select("id").collect()) and len(set(ids)) == len(ids)
    token = encode_cursor(1, "p", "s", 7)
    assert decode_cursor(token) == (1, "p", "s", 7)
    # a first file beyond the byte cap ends the pages instead of handing the same cursor back
    capped = Service(spark, c, Limits(content_bytes=1, statement_s=60.0))
    out = capped.search("a", limit=2, cursor=encode_cursor(0, "", ""), paged=True)
    assert out["truncation_reason"] == "byte_cap" and out["next_cursor"] is None


def test_files_given_up_are_named(spark, corpus):
    from sourcelume.operators.grep import Matchers, highlight

    text = "aab" * 4000
    files = spark.createDataFrame([(1, 1, "r", "p", "s", "go", ["main"], text)], "id int, repo_id int, repo_name string, path string, content_sha string, lang string, branches array<string>, content string")
    rows = highlight(files, Matchers.of(parse("/a+b/")), 1e-9).collect()
    assert [(r["id"], r["line"], r["byte_ranges"]) for r in rows] == [(1, None, None)]


def test_plans(spark, corpus, tmp_path):
    """What a plan must show: pruned columns, pushed filters, dimensions broadcast only while they are small."""
    from sourcelume.session import broadcast_if_small

    plan = lambda df: df._jdf.queryExecution().toString()
    corpus.files.write.parquet(str(tmp_path / "files.parquet"))
    stored = Corpus(corpus.repos, spark.read.parquet(str(tmp_path / "files.parquet")), corpus.symbols, corpus.reference_edges, corpus.repo_branches, corpus.chunks)
    text = plan(select_files(stored, parse("lang:go -branch:x")).select("id"))
    scan = next(line for line in text.split("\n") if "FileScan parquet" in line)
    assert "EqualTo(lang,go)" in scan and "content" not in scan.split("ReadSchema")[1]
    small, large = spark.range(10).withColumnRenamed("id", "k"), spark.range(10**9).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(large.join(broadcast_if_small(small), "k")) and "hint" not in plan(broadcast_if_small(large)).lower()


def test_bucketed_join_moves_nothing(spark):
    from sourcelume.sources.tables import save_bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = save_bucketed(spark.range(100).selectExpr("id", "id * 2 AS x"), "t_files", "id", 4)
        chunks = save_bucketed(spark.range(300).selectExpr("id % 100 AS file_id", "id AS chunk"), "t_chunks", "file_id", 4)
        joined = chunks.join(files, chunks["file_id"] == files["id"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("t_files", "t_chunks"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_all_queries_at_once_equal_one_by_one(spark):
    import random

    from sourcelume.operators.semantic import bm25, bm25_each, fuse, nearest, nearest_each, postings

    rng = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    ts = lambda: " ".join(f"'{w}':{','.join(str(k + 1) for k in range(rng.randrange(1, 4)))}" for w in rng.sample(words, 3))
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], ts()) for i in range(80)] + [(90, None, "'w1':1"), (91, [1.0] * 4, None), (92, [0.0] * 4, ""), (93, [float("nan")] * 4, "'w2':2,3")]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>, ts string").repartition(3)
    asked = [(1, [1.0, 0.0, 0.0, 1.0], ["w1", "w2"]), (2, [0.0, -1.0, 2.0, 0.0], ["w2", "nothing", ""]), (3, None, ["w1"]), (4, [0.0] * 4, [])]
    queries = spark.createDataFrame(asked, "query_id int, vector array<float>, words array<string>")
    near = {(r["query_id"], r["id"], round(r["similarity"], 6)) for r in nearest_each(chunks, queries, 7, block=1).collect()}
    assert near == {(q, r["id"], round(r["similarity"], 6)) for q, v, _ in asked[:2] for r in nearest(chunks, v, 7).collect()}
    text = {(r["query_id"], r["id"], round(r["score"], 6)) for r in bm25_each(chunks, queries, 7).collect()}
    assert text == {(q, r["id"], round(r["score"], 6)) for q, _, w in asked for r in bm25(chunks, w, 7).collect()}
    stored = postings(chunks)
    assert {(r["id"], r["score"]) for r in bm25(chunks, ["w1", "w2"], 7, stored).collect()} == {(r["id"], r["score"]) for r in bm25(chunks, ["w1", "w2"], 7).collect()}
    both = fuse(nearest_each(chunks, queries, 7), bm25_each(chunks, queries, 7), 3, ("query_id",))
    one = fuse(nearest(chunks, asked[0][1], 7), bm25(chunks, ["w1", "w2"], 7), 3)
    assert [(r["id"], r["rrf_score"]) for r in both.where("query_id = 1").orderBy(F.desc("rrf_score"), "id").collect()] == [(r["id"], r["rrf_score"]) for r in one.orderBy(F.desc("rrf_score"), "id").collect()]
    assert nearest_each(chunks, queries.limit(0)).count() == 0 and bm25_each(chunks.limit(0), queries).count() == 0


def test_stored_trigrams_spare_contents(spark, corpus, tmp_path):
    """With a stored table the scan of files gets the ids of those that can match; results stay the same."""
    from dataclasses import replace

    from sourcelume.operators import trigrams as tri

    corpus.files.write.parquet(str(tmp_path / "f"))
    tri.write(tri.build(corpus.files), str(tmp_path / "g"), 2)
    files, grams = spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "g"))
    plain, indexed = replace(corpus, files=files), replace(corpus, files=files, grams=grams)
    for q in ("handler", "/foo.*bar/", "handler or foo_bar", "repo:^acme lang:go -handler", "zzz", "a"):
        assert {r["id"] for r in select_files(indexed, parse(q)).collect()} == {r["id"] for r in select_files(plain, parse(q)).collect()}, q
    scan = select_files(indexed, parse("foo_bar"))._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in scan or "EqualTo(id" in scan
    assert {(r["id"], r["line"]) for r in grep(indexed, "handler").collect()} == {(r["id"], r["line"]) for r in grep(plain, "handler").collect()}


def test_service_limits(spark, corpus):
    import threading
    from dataclasses import replace

    slow = Service(spark, corpus, Limits(statement_s=0.0))
    assert slow.search("handler")["query_too_broad"] and slow.references("helperFn")["query_too_broad"] and slow.semantic("handler words")["query_too_broad"] and not slow.ready()
    bare = Service(spark, replace(corpus, chunks=corpus.chunks.drop("embedding")), PATIENT)
    assert bare.semantic("handler")["semantic_schema_missing"] and not Service(spark, corpus, PATIENT).semantic("handler")["semantic_schema_missing"]
    assert Service(spark, corpus, PATIENT, semantic_enabled=False).semantic("x")["disabled"] and bare.health() == {"status": "ok"}
    # a caller waits for a slot while all are taken
    one = Service(spark, corpus, Limits(concurrency=1, statement_s=60.0))
    one._slots.acquire()
    done = []
    t = threading.Thread(target=lambda: done.append(one.file("acme/widgets", "src/handler.go")["found"]))
    t.start()
    t.join(1.0)
    assert not done
    one._slots.release()
    t.join(60)
    assert done == [True]
    pages, after = [], None
    paged = Service(spark, corpus, Limits(most_rows=4, statement_s=60.0))
    while rows := paged.repos(after):
        pages += [r["repo"] for r in rows]
        after = rows[-1]["repo"]
    assert pages == sorted(r["repo"] for r in Service(spark, corpus, PATIENT).repos()) and len(pages) == 6
