from sourcelume.llm.foreign_source import block_hashes, by_text, families, files_to_set_aside, head, subtree_hashes

REPOS = [(1, "acme/libkit"), (2, "beta/app"), (3, "gamma/tool"), (4, "delta/fork")]
FSCHEMA = "id int, repo_id int, path string, lang string, content string, content_sha string, reason string"


def f(i, repo, path, content="x = 1\n", lang="python", sha=None):
    return (i, repo, path, lang, content, sha or f"sha-{content}", "mine")


def run(spark, rows):
    files = spark.createDataFrame(rows, FSCHEMA)
    return {r["id"]: list(r["reasons"]) for r in files_to_set_aside(files, spark.createDataFrame(REPOS, "id int, name string")).collect()}


def text(name, n=40, edits=()):
    return "\n".join(f"{name} = step_{name}({i}, {'edited' if i in edits else i * 7})" for i in range(n))


def test_vendored(spark):
    lib = text("lib")
    rows = [
        f(1, 1, "src/alpha.py", lib), f(2, 2, "vendor/libkit/alpha.py", lib), f(3, 3, "src/libkit/alpha.py", text("lib", edits=range(0, 40, 3))), f(4, 3, "external/libkit-2.1/alpha.py", lib),
        f(5, 4, "src/other.py", text("same")), f(6, 3, "src/other.py", text("same")),  # a fork of a file shares as well
        f(7, 2, "src/vendors/own.py", text("ours")), f(8, 2, "lib/alpha.py", "# Copied from acme/libkit at 0badcafe.\n" + lib), f(9, 1, "lib/beta.py", "# Copied from acme/libkit at 0badcafe.\n"),
        f(10, 2, "vendor/mine/only.py", "nobody else has it"), f(11, 1, "libkit/gamma.py", text("own")), f(12, 3, "third_party/pkg/deep/one.py", text("tree")), f(13, 2, "tools/pkg/deep/one.py", text("tree")),
        f(14, 3, "lib/zeta.py", "# Copied from acme/libkit at 0badcafe.\n" + text("zeta")),  # there is no zeta.py to compare with
        f(15, 4, "lib/alpha.py", "# Copied from acme/libkit at 0badcafe.\n" + text("unlike")),  # the library's file is another one
        f(16, 4, "src/libkit/renamed.py", lib), f(17, 4, "deps/empty.py", ""), f(18, 3, "src/empty.py", ""),
    ]
    got = run(spark, rows)
    assert got == {i: ["vendored"] for i in (2, 3, 4, 8, 12, 14, 16)}


def test_names_alone_mark_nothing(spark):
    rows = [
        f(1, 2, "lib/a/x.py", text("x")), f(2, 2, "lib/a/y.py", text("y")), f(3, 3, "lib/a/x.py", text("x")), f(4, 3, "lib/a/y.py", text("y")),  # a whole subtree that nobody has at its root
        f(5, 2, "libkit/index.js", text("p"), "javascript"), f(6, 1, "src/index.js", text("q"), "javascript"),  # under the name of a repository that has an unlike file of this name
        f(7, 2, "deps/config.py", text("r")), f(8, 3, "src/config.py", text("s")),
    ]
    assert run(spark, rows) == {i: ["vendored"] for i in (1, 2, 3, 4)}


def test_subtree_with_an_origin(spark):
    own = [f(i, 1, f"core/{n}.py", text(n)) for i, n in enumerate("abc", 1)]
    copy = [f(i, 2, f"src/inner/core/{n}.py", text(n)) for i, n in enumerate("abc", 11)]
    assert run(spark, own + copy) == {i: ["vendored"] for i in (11, 12, 13)}
    placed = [f(i, 3, f"vendor/{n}.py", text(n)) for i, n in enumerate("abc", 21)]
    assert run(spark, own + placed) == {i: ["vendored"] for i in (21, 22, 23)}


def test_forks_are_no_evidence(spark):
    """Two repositories that share most files are one family: what they have in their own places for foreign code is no
    copy of each other; a third, unrelated one makes it one."""
    both = [f(100 * r + i, r, f"src/m{i}.py", text(f"m{i}")) for r in (2, 4) for i in range(90)] + [f(r, r, "deps/part.py", text("part")) for r in (2, 4)]
    assert run(spark, both) == {}
    got = run(spark, both + [f(3, 3, "src/part.py", text("part"))])
    assert got == {2: ["vendored"], 4: ["vendored"]}
    rows = spark.createDataFrame([(r[1], r[2], r[5]) for r in both], "repo_id int, path string, sha string")
    assert {(r["repo_id"], r["family"]) for r in families(rows).collect()} == {(2, 2), (4, 2)} and families(rows.where("repo_id = 2")).count() == 0


def test_blocks():
    a, b, c, d = block_hashes([text("t", 200), text("t", 200, range(0, 200, 5)), text("u", 200), "\n"], ["n", "n", "n", "n"])
    assert len(set(a)) == 32 and len(set(a) & set(b)) > 12 and not set(a) & set(c) and not len(d)
    other = block_hashes([text("t", 200)], ["m"])[0]
    assert not set(a) & set(other) and block_hashes([], []) == [] and [len(x) for x in block_hashes([None, ""], [None, "a"])] == [0, 0]


def test_head():
    java = 'package a.b;\n\nimport java.util.List;\n\n/** Made. */\n@Generated("tool")\npublic class A {\n  // Code generated by hand\n}\n'
    assert "Made." in head(java) and "@Generated" in head(java) and "by hand" not in head(java)
    assert by_text("A.java", "java", java)[0] == "generated" and by_text("B.java", "java", java.replace("@Generated", "@Entity"))[0] is None
    assert by_text("a.js", "javascript", '"use strict";\n// Code generated by x. DO NOT EDIT.\nlet a = 1;\n')[0] == "generated"
    assert by_text("a.go", "go", 'package p\n\nimport (\n\t"fmt"\n)\n\n// Code generated by x. DO NOT EDIT.\nvar a = 1\n')[0] == "generated"
    assert by_text("a.go", "go", 'package p\n\nvar a = 1\n// Code generated by x. DO NOT EDIT.\n')[0] is None


def test_generated_minified_data(spark):
    code = "function f(a, b) {\n  return a + b;\n}\n" * 40
    rows = [
        f(1, 1, "a/x_pb2.py"), f(2, 1, "Cargo.lock", None, None), f(3, 1, "a/y.py", "# Code generated by tool. DO NOT EDIT.\nx = 1\n"), f(4, 1, "a/z.py", "# Do not edit the order below without asking.\nx = 1\n"),
        f(5, 1, "a/w.py", "x = 1\n# Code generated by tool. DO NOT EDIT.\n"), f(6, 1, "a/m.js", "!function(){" + "var abc=fun(bcd,cde)||[];" * 100 + "}()", "javascript"), f(7, 1, "a/n.js", code, "javascript"),
        f(8, 1, "a/d.py", "X = [\n" + "    1021, 2330, 3444, 4550, 5666,\n" * 60 + "]\n"), f(9, 1, "a/e.py", "SIZES = [1, 2, 3]\n" + "def f(x):\n    return x\n" * 30), f(10, None, None, None, None, None), f(11, 1, "src/generators/a.py"), f(12, 9, "a/q.min.js", "x", None),
    ]
    assert run(spark, [*rows, rows[0]]) == {1: ["generated"], 2: ["generated"], 3: ["generated"], 6: ["minified"], 8: ["data"], 12: ["minified"]}
    assert run(spark, rows[:0]) == {}


def test_subtree_hashes(spark):
    rows = [(1, "a/b/x", "s1"), (1, "a/b/y", "s2"), (1, "c", "s3"), (2, "q/b/y", "s2"), (2, "q/b/x", "s1"), (3, "a/b/x", "s9"), (3, "a/b/y", "s2"), (3, "a/b/y", "s2"), (4, "z/x", "s2"), (4, "z/y", "s1"), (5, None, "s1")]
    nodes = {(r["repo_id"], r["path"]): (r["hash"], r["files"]) for r in subtree_hashes(spark.createDataFrame(rows, "repo_id int, path string, sha string")).collect()}
    assert nodes[1, "a/b"] == nodes[2, "q/b"] and nodes[1, "a/b"][0] != nodes[3, "a/b"][0] and nodes[1, "a/b"][0] != nodes[4, "z"][0]
    assert nodes[1, "a"] == nodes[2, "q"] and nodes[1, "a"][1] == 2 and nodes[3, "a"][1] == 2 and len(nodes) == 7


def test_by_text_edges():
    assert by_text("a.py", None, "") == (None, None)
    assert by_text("a.js", None, "x" * 300_000)[0] in (None, "minified")
