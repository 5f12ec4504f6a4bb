"""Every query of the core by name, and SQL that states the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.chunks import chunk_files, embed_chunks, hash_embedder
from .functions.extract import edges_of, extract_files, symbols_of
from .functions.text import content_sha, cosine, glob_pattern, language, lines, usable_vector
from .operators import index as idx, migrate as mig, references as ref, trigrams as tri
from .operators.grep import grep, within_bytes
from .operators.search import file_lines, get_file, list_repos, merged_files, permalink_branch, resolve_commits
from .operators.semantic import bm25_each, fuse, hybrid_each, leg_rank, nearest_each, scoped_chunks
from .operators.symbols import find_symbols, ordered_symbols
from .plans.corpus import Corpus, default_branch, has_branch, page, select_files
from .plans.language import case_of, parse, split_prose
from .sources.listing import choose_branches, choose_repos
from .sources.tables import spread, table
from .streaming.incremental import event_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


# --- predicates -------------------------------------------------------------------------------------------------------

ON_DEFAULT = "list_contains(f.branches, coalesce(r.default_branch, 'HEAD'))"
FROM = "FROM files f JOIN repos r ON r.id = f.repo_id"
FILE_ROW = "f.id AS file_id, f.repo_id AS repo_id, f.path AS path"
SYM = "EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = f.id AND contains(lower(s.name), '{0}'))"
COMMIT = "EXISTS (SELECT 1 FROM repo_branches b WHERE b.repo_id = f.repo_id AND list_contains(f.branches, b.branch) AND starts_with(lower(b.last_indexed_commit), '{0}'))"

#: name: (query text, SQL condition without the default branch, whether the default branch is implied)
PREDICATES = {
    "pred_substring_ci": ("TOKEN", "contains(lower(f.content), 'token')", True),
    "pred_substring_cs": ("case:yes Token", "contains(f.content, 'Token')", True),
    "pred_like_escape": ("%s", "contains(lower(f.content), '%s')", True),
    "pred_underscore_literal": ("log_", "contains(lower(f.content), 'log_')", True),
    "pred_regex_ci": ("/RETURN.*null/", "regexp_matches(f.content, 'return.*null', 'si')", True),
    "pred_regex_cs": ("case:yes /return [A-Z]?[a-z]+[A-Z][A-Za-z]*;/", "regexp_matches(f.content, 'return [A-Z]?[a-z]+[A-Z][A-Za-z]*;', 's')", True),
    "pred_regex_anchored": (r"/^# .*\n$/", r"regexp_matches(f.content, '^# .*\n$', 's')", True),
    "pred_repo": ("repo:^PA -lang:go", "regexp_matches(r.name, '^pa', 'i') AND NOT (f.lang = 'go')", True),
    "pred_path": (r"file:^SRC/.*\.py$", r"regexp_matches(f.path, '^src/.*\.py$', 'si')", True),
    "pred_path_case": (r"case:yes file:^src/.*\.py$", r"regexp_matches(f.path, '^src/.*\.py$', 's')", True),
    "pred_lang": ("lang:Rust", "f.lang = 'rust'", True),
    "pred_lang_unknown": ("lang:cobol", "f.lang = 'cobol'", True),
    "pred_sym_exists": ("sym:Lantern", SYM.format("lantern"), True),
    "pred_sym_under_or": ("sym:lantern or lang:java", f"({SYM.format('lantern')} OR f.lang = 'java')", True),
    "pred_sym_negated": ("lang:python -sym:lantern", f"f.lang = 'python' AND NOT {SYM.format('lantern')}", True),
    "pred_branch": ("branch:develop lang:go", "list_contains(f.branches, 'develop') AND f.lang = 'go'", False),
    "pred_commit": ("commit:abcdef0 or lang:tsx", f"({COMMIT.format('abcdef0')} OR f.lang = 'tsx')", False),
    "pred_not_null": ("-token", "NOT contains(lower(f.content), 'token')", True),
    "pred_and_or": ("(token or session) return -lang:go", "(contains(lower(f.content), 'token') OR contains(lower(f.content), 'session')) AND contains(lower(f.content), 'return') AND NOT (f.lang = 'go')", True),
    "pred_branch_in_or_opts_out": ("branch:develop or lang:rust", "(list_contains(f.branches, 'develop') OR f.lang = 'rust')", False),
    "pred_branch_negated": ("-branch:develop lang:rust", "NOT list_contains(f.branches, 'develop') AND f.lang = 'rust'", True),
    "pred_branch_double_negated": ("--branch:develop", "list_contains(f.branches, 'develop')", False),
    "pred_default_branch": ("lang:typescript", "f.lang = 'typescript'", True),
    "pred_last_case_wins": ("case:yes case:no RETURN", "contains(lower(f.content), 'return')", True),
    "pred_quoted": ('"return nil"', "contains(lower(f.content), 'return nil')", True),
    "pred_null_content": ("file:md$ or -file:.", "(regexp_matches(f.path, 'md$', 'si') OR NOT regexp_matches(f.path, '.', 'si'))", True),
}


def _predicate(text: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        files = select_files(Corpus.load(spark, sf), parse(text), case_of(text))
        return files.select(F.col("id").alias("file_id"), "repo_id", "path")

    return run


for _name, (_text, _where, _implied) in PREDICATES.items():
    _add(_name, _predicate(_text), f"SELECT {FILE_ROW} {FROM} WHERE {_where}" + (f" AND {ON_DEFAULT}" if _implied else ""))


# --- order, limit, paging ---------------------------------------------------------------------------------------------


@query(f"SELECT {FILE_ROW} {FROM} WHERE f.lang = 'go' AND {ON_DEFAULT} ORDER BY f.repo_id, f.path, f.content_sha, f.id LIMIT 200")
def page_first(spark, sf):
    files = select_files(Corpus.load(spark, sf), parse("lang:go"))
    return files.orderBy("repo_id", "path", "content_sha", "id").limit(200).select(F.col("id").alias("file_id"), "repo_id", "path")


@query(f"SELECT {FILE_ROW} {FROM} WHERE f.lang = 'go' AND {ON_DEFAULT} AND (f.repo_id, f.path, f.content_sha) > (100, 'm', '')")
def page_after_cursor(spark, sf):
    files = page(select_files(Corpus.load(spark, sf), parse("lang:go")), None, (100, "m", ""))
    return files.select(F.col("id").alias("file_id"), "repo_id", "path")


@query(
    f"""WITH o AS (SELECT f.*, row_number() OVER (ORDER BY f.repo_id, f.path, f.content_sha, f.id) AS n {FROM} WHERE f.lang = 'java' AND f.content IS NOT NULL AND {ON_DEFAULT}),
    s AS (SELECT *, coalesce(sum(strlen(content)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM (SELECT * FROM o WHERE n <= 50)),
    t AS (SELECT *, max(CASE WHEN ahead + length(content) > 60000 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS stopped FROM s)
    SELECT id AS file_id, path FROM t WHERE stopped = 0"""
)
def grep_byte_cap(spark, sf):
    files = select_files(Corpus.load(spark, sf), parse("lang:java")).where("content IS NOT NULL")
    return within_bytes(files.orderBy("repo_id", "path", "content_sha", "id").limit(50), 60_000).select(F.col("id").alias("file_id"), "path")


# --- grep -------------------------------------------------------------------------------------------------------------

LINES = """SELECT f.id AS file_id, f.repo_id AS repo_id, f.path AS path, n AS line, regexp_replace(x, '\\r$', '') AS text
FROM (SELECT f.*, unnest(string_split(f.content, chr(10))) AS x, generate_subscripts(string_split(f.content, chr(10)), 1) AS n {frm} WHERE {where}) f"""


def _lines(text: str) -> Query:
    def run(spark, sf):
        return grep(Corpus.load(spark, sf), text).select(F.col("id").alias("file_id"), "repo_id", "path", "line", "text")

    return run


_add("grep_lines", _lines("token"), LINES.format(frm=FROM, where=f"contains(lower(f.content), 'token') AND {ON_DEFAULT}") + " WHERE contains(lower(x), 'token')")
_add("grep_lines_cs", _lines("case:yes lang:java String"), LINES.format(frm=FROM, where=f"f.lang = 'java' AND contains(f.content, 'String') AND {ON_DEFAULT}") + " WHERE contains(x, 'String')")
_add(
    "grep_and_shows_either",
    _lines("lang:python raise return"),
    LINES.format(frm=FROM, where=f"f.lang = 'python' AND contains(lower(f.content), 'raise') AND contains(lower(f.content), 'return') AND {ON_DEFAULT}") + " WHERE contains(lower(x), 'raise') OR contains(lower(x), 'return')",
)
_add("grep_regex_lines", _lines("/[a-z]+Error[(]/"), LINES.format(frm=FROM, where=f"regexp_matches(f.content, '[a-z]+error[(]', 'si') AND {ON_DEFAULT}") + " WHERE regexp_matches(x, '[a-z]+error[(]', 'i')")
_add("grep_negative_not_shown", _lines("lang:go panic -defer"), LINES.format(frm=FROM, where=f"f.lang = 'go' AND contains(lower(f.content), 'panic') AND NOT contains(lower(f.content), 'defer') AND {ON_DEFAULT}") + " WHERE contains(lower(x), 'panic')")


@query(f"""WITH l AS (SELECT id, n, string_split(regexp_replace(x, '\\r$', ''), '、') AS p FROM (SELECT f.id, unnest(string_split(f.content, chr(10))) AS x, generate_subscripts(string_split(f.content, chr(10)), 1) AS n
       {FROM} WHERE contains(f.content, '、') AND {ON_DEFAULT}))
       SELECT id AS file_id, n AS line, array_to_string(list_transform(range(1, len(p)), lambda i: CAST(strlen(array_to_string(p[1:i], '、')) AS VARCHAR) || '-' || CAST(strlen(array_to_string(p[1:i], '、')) + 3 AS VARCHAR)), ',') AS ranges FROM l WHERE len(p) > 1"""
)
def grep_multibyte_ranges(spark, sf):
    found = grep(Corpus.load(spark, sf), "、")
    spans = F.transform("byte_ranges", lambda s: F.concat_ws("-", s[0].cast("string"), s[1].cast("string")))
    return found.select(F.col("id").alias("file_id"), "line", F.array_join(spans, ",").alias("ranges"))


@query(
    f"""SELECT f.id AS file_id, CAST(sum(len(string_split(lower(x), 'token')) - 1) AS BIGINT) AS spans FROM (SELECT f.id, unnest(string_split(f.content, chr(10))) AS x {FROM} WHERE contains(lower(f.content), 'token') AND {ON_DEFAULT}) f
    WHERE contains(lower(x), 'token') GROUP BY f.id"""
)
def grep_match_count(spark, sf):
    found = grep(Corpus.load(spark, sf), "token")
    return found.groupBy(F.col("id").alias("file_id")).agg(F.sum(F.size("byte_ranges")).cast("long").alias("spans"))


# --- symbols and merged results ---------------------------------------------------------------------------------------

SYMBOLS = f"""SELECT s.id AS symbol_id, s.file_id AS file_id, f.repo_id AS repo_id, f.path AS path, s.name AS name, s.kind AS kind, s.start_line AS start_line
FROM symbols s JOIN files f ON f.id = s.file_id JOIN repos r ON r.id = f.repo_id WHERE {ON_DEFAULT}"""


def _symbols(text: str) -> Query:
    return lambda spark, sf: find_symbols(Corpus.load(spark, sf), text).select("symbol_id", "file_id", "repo_id", "path", "name", "kind", "start_line")


_add("symbol_defs", _symbols("sym:ledger"), SYMBOLS + " AND contains(lower(s.name), 'ledger')")
_add("symbol_defs_cs", _symbols("case:yes sym:Ledger"), SYMBOLS + " AND contains(s.name, 'Ledger')")
_add(
    "symbol_defs_either",
    _symbols("sym:ledger sym:token"),
    SYMBOLS + " AND (contains(lower(s.name), 'ledger') OR contains(lower(s.name), 'token')) AND EXISTS (SELECT 1 FROM symbols a WHERE a.file_id = f.id AND contains(lower(a.name), 'ledger')) AND EXISTS (SELECT 1 FROM symbols b WHERE b.file_id = f.id AND contains(lower(b.name), 'token'))",
)


@query(SYMBOLS.replace("s.start_line AS start_line", "s.start_line AS start_line, f.content_sha AS content_sha") + " AND contains(lower(s.name), 'e') ORDER BY f.repo_id, f.path, f.content_sha, s.start_line NULLS LAST, s.name, s.id LIMIT 200")
def symbols_ordered(spark, sf):
    return ordered_symbols(find_symbols(Corpus.load(spark, sf), "sym:e"), 200).select("symbol_id", "file_id", "repo_id", "path", "name", "kind", "start_line", "content_sha")


@query(
    f"""WITH f AS (SELECT f.id, f.content, f.repo_id, f.path, f.content_sha {FROM} WHERE {ON_DEFAULT} AND contains(lower(f.content), 'return') AND {SYM.format('ledger')}),
    l AS (SELECT id, n, regexp_replace(x, '\\r$', '') AS t FROM (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f)),
    m AS (SELECT id, n AS line, t, NULL AS symbol, len(string_split(lower(t), 'return')) - 1 AS k FROM l WHERE contains(lower(t), 'return')
      UNION ALL SELECT f.id, s.start_line, NULL, s.name, 1 FROM symbols s JOIN f ON f.id = s.file_id WHERE contains(lower(s.name), 'ledger'))
    SELECT id AS file_id, CAST(sum(k) AS BIGINT) AS match_count, count(*) AS rows,
      string_agg(coalesce(CAST(line AS VARCHAR), '-') || '|' || coalesce(t, '') || '|' || coalesce(symbol, ''), '~' ORDER BY coalesce(line, 2147483647), t NULLS FIRST, symbol NULLS FIRST) AS matches FROM m GROUP BY id"""
)
def merged_counts(spark, sf):
    m = merged_files(Corpus.load(spark, sf), "return sym:ledger")
    none = F.lit("")
    each = F.transform("matches", lambda x: F.concat_ws("|", F.coalesce(x["line"].cast("string"), F.lit("-")), F.coalesce(x["text"], none), F.coalesce(x["symbol"], none)))
    return m.select(F.col("id").alias("file_id"), F.col("match_count").cast("long").alias("match_count"), F.size("matches").cast("long").alias("rows"), F.array_join(each, "~").alias("matches"))


# --- repositories, files, commits -------------------------------------------------------------------------------------


@query(
    """SELECT r.id AS repo_id, r.name AS repo, coalesce(r.default_branch, 'HEAD') AS default_branch, coalesce(string_agg(b.branch, ',' ORDER BY b.branch), 'HEAD') AS branches
    FROM repos r LEFT JOIN repo_branches b ON b.repo_id = r.id GROUP BY 1, 2, 3"""
)
def repos_listed(spark, sf):
    return list_repos(Corpus.load(spark, sf)).select("repo_id", "repo", "default_branch", F.array_join("branches", ",").alias("branches"))


@query(
    """WITH t AS (SELECT r.id, b.branch, b.last_indexed_commit AS c, row_number() OVER (PARTITION BY r.id ORDER BY (b.branch = coalesce(r.default_branch, 'HEAD')) DESC, b.branch) AS n FROM repos r LEFT JOIN repo_branches b ON b.repo_id = r.id)
    SELECT id AS repo_id, c AS commit FROM t WHERE n = 1"""
)
def repos_default_commit(spark, sf):
    return list_repos(Corpus.load(spark, sf)).select("repo_id", "commit")


@query(f"SELECT f.id AS file_id, f.path AS path, r.name AS repo {FROM} WHERE r.name = (SELECT name FROM repos WHERE id = 17) AND f.path = (SELECT min(path) FROM files WHERE repo_id = 17) AND {ON_DEFAULT}")
def file_on_default_branch(spark, sf):
    c = Corpus.load(spark, sf)
    repo = c.repos.where("id = 17").first()["name"]
    path = c.files.where("repo_id = 17").agg(F.min("path")).first()[0]
    return get_file(c, repo, path or "").select(F.col("id").alias("file_id"), "path", "repo")


@query("SELECT id AS file_id, n AS line, x AS text FROM (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files WHERE content IS NOT NULL) WHERE n >= 3")
def file_lines_from(spark, sf):
    return file_lines(Corpus.load(spark, sf).files, 3).withColumnRenamed("id", "file_id")


@query("SELECT DISTINCT b.repo_id AS repo_id, r.name AS repo, b.branch AS branch, b.last_indexed_commit AS commit FROM repo_branches b JOIN repos r ON r.id = b.repo_id WHERE starts_with(lower(b.last_indexed_commit), 'a') OR starts_with(lower(b.last_indexed_commit), '0')")
def commit_lookup(spark, sf):
    return resolve_commits(Corpus.load(spark, sf), ["a", "0"]).select("repo_id", "repo", "branch", "commit")


@query("""SELECT id AS file_id, CASE WHEN len(list_intersect(branches, ['develop', 'main'])) > 0 THEN list_sort(list_intersect(branches, ['develop', 'main']))[1] ELSE list_sort(branches)[1] END AS branch FROM files""")
def permalinks(spark, sf):
    return Corpus.load(spark, sf).files.select(F.col("id").alias("file_id"), permalink_branch(F.col("branches"), ["main", "develop"]).alias("branch"))


# --- references -------------------------------------------------------------------------------------------------------

SITES = f"""sites AS (SELECT DISTINCT e.id AS edge_id, e.edge_kind, e.target_name, e.line, f.id AS file_id, f.repo_id, f.path FROM reference_edges e JOIN files f ON f.id = e.file_id JOIN repos r ON r.id = f.repo_id WHERE {ON_DEFAULT})"""
DEFS = f"""defs AS (SELECT DISTINCT s.id AS symbol_id, s.name, s.kind, s.start_line, f.id AS c_file_id, f.repo_id AS c_repo_id, f.path AS c_path FROM symbols s JOIN files f ON f.id = s.file_id JOIN repos r ON r.id = f.repo_id WHERE {ON_DEFAULT})"""
RESOLVED = f"""WITH {SITES}, {DEFS}, counts AS (SELECT name, count(*) AS n FROM defs GROUP BY name),
resolved AS (SELECT s.*, coalesce(c.n, 0) AS candidate_count, CASE WHEN c.n = 1 THEN 'unique' WHEN c.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM sites s LEFT JOIN counts c ON c.name = s.target_name)"""


@query(f"WITH {SITES} SELECT edge_id, edge_kind, target_name, line, file_id, path FROM sites")
def reference_sites(spark, sf):
    return ref.sites(Corpus.load(spark, sf)).select("edge_id", "edge_kind", "target_name", "line", "file_id", "path")


@query(f"WITH {DEFS} SELECT name AS target_name, count(*) AS candidate_count FROM defs GROUP BY name")
def reference_candidate_counts(spark, sf):
    return ref.candidate_counts(Corpus.load(spark, sf))


@query(f"WITH {DEFS} SELECT name AS target_name, symbol_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_repo_id, c_path, start_line NULLS LAST, symbol_id) AS nth FROM defs) WHERE nth <= 3")
def reference_candidate_cap(spark, sf):
    return ref.capped_definitions(Corpus.load(spark, sf), cap=3).select("target_name", F.col("c_symbol_id").alias("symbol_id"), "nth")


@query(RESOLVED + " SELECT edge_id, target_name, candidate_count, resolution FROM resolved")
def references_resolved(spark, sf):
    return ref.resolve(Corpus.load(spark, sf)).select("edge_id", "target_name", "candidate_count", "resolution")


@query(
    RESOLVED
    + """, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_repo_id, c_path, start_line NULLS LAST, symbol_id) AS nth FROM defs) WHERE nth <= 32)
    SELECT r.edge_id, c.symbol_id, row_number() OVER (PARTITION BY r.edge_id ORDER BY (r.repo_id = c.c_repo_id) DESC, (r.edge_kind = 'call' AND coalesce(c.kind IN ('function', 'method', 'class'), false)) DESC,
      (r.file_id = c.c_file_id) DESC, c.c_repo_id, c.c_path, coalesce(c.start_line, 0), c.symbol_id) AS candidate_rank FROM resolved r JOIN capped c ON c.name = r.target_name"""
)
def references_ranked(spark, sf):
    c = Corpus.load(spark, sf)
    return ref.ranked_candidates(ref.sites(c), c).select("edge_id", F.col("c_symbol_id").alias("symbol_id"), "candidate_rank")


@query(RESOLVED + " SELECT count(*) FILTER (resolution = 'unique') AS \"unique\", count(*) FILTER (resolution = 'ambiguous') AS ambiguous, count(*) FILTER (resolution = 'unresolved') AS unresolved FROM resolved")
def references_summary(spark, sf):
    return ref.resolution_summary(ref.resolve(Corpus.load(spark, sf)))


@query(RESOLVED + " SELECT edge_kind, resolution, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY edge_kind), 4) AS pct FROM resolved GROUP BY 1, 2")
def references_distribution(spark, sf):
    return ref.resolution_distribution(ref.resolve(Corpus.load(spark, sf)))


@query(RESOLVED + " SELECT candidate_count, count(*) AS n FROM resolved WHERE resolution = 'ambiguous' GROUP BY 1")
def references_ambiguity(spark, sf):
    return ref.ambiguity_histogram(ref.resolve(Corpus.load(spark, sf)))


@query(RESOLVED + " SELECT edge_id, target_name, path, line, resolution FROM resolved WHERE edge_kind = 'import' AND repo_id = 17")
def imports_of_repo(spark, sf):
    c = Corpus.load(spark, sf)
    repo = c.repos.where("id = 17").first()["name"]
    return ref.resolve(c, kind="import", repo=repo).select("edge_id", "target_name", "path", "line", "resolution")


@query(RESOLVED + " SELECT edge_id, path, line, candidate_count FROM resolved WHERE edge_kind = 'import' AND target_name = (SELECT min(target_name) FROM reference_edges WHERE edge_kind = 'import')")
def imported_by(spark, sf):
    c = Corpus.load(spark, sf)
    target = c.reference_edges.where("edge_kind = 'import'").agg(F.min("target_name")).first()[0]
    return ref.resolve(c, target=target or "", kind="import").select("edge_id", "path", "line", "candidate_count")


# --- semantic ---------------------------------------------------------------------------------------------------------

USABLE = "embedding IS NOT NULL AND len(embedding) = 128 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)"
SCOPED = f"scoped AS (SELECT c.id, c.embedding, c.ts, f.lang, f.path, r.name AS repo FROM chunks c JOIN files f ON f.id = c.file_id JOIN repos r ON r.id = f.repo_id WHERE {ON_DEFAULT} {{extra}})"
GO_PKG = "AND f.lang = 'go' AND regexp_matches(f.path, '^pkg/', 'si')"
SOUND = f"sound AS MATERIALIZED (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM scoped WHERE {USABLE})"
NEAR = """near AS (SELECT q.query_id, s.id, list_cosine_similarity(s.e, CAST(q.query_embedding AS DOUBLE[])) AS similarity FROM sound s, search_queries q
 QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(s.e, CAST(q.query_embedding AS DOUBLE[])), 12) DESC, s.id) <= 200)"""
HITS = r"""docs AS (SELECT id, list_transform(regexp_extract_all(ts, '''((?:[^'']|'''')+)'':([0-9]+[A-D]?(?:,[0-9]+[A-D]?)*)', 1), lambda w: lower(replace(w, '''''', ''''))) AS w,
 list_transform(regexp_extract_all(ts, '''((?:[^'']|'''')+)'':([0-9]+[A-D]?(?:,[0-9]+[A-D]?)*)', 2), lambda p: len(string_split(p, ','))) AS n FROM scoped WHERE ts IS NOT NULL),
 sized AS (SELECT id, w, n, coalesce(list_sum(n), 0) AS dl FROM docs), st AS (SELECT count(*) AS nd, avg(dl) AS al FROM sized),
 qw AS (SELECT DISTINCT query_id, unnest(string_split(query_text, ' ')) AS word FROM search_queries),
 hits AS (SELECT qw.query_id, h.* FROM (SELECT id, dl, unnest(w) AS word, unnest(n) AS tf FROM sized) h JOIN qw ON qw.word = h.word),
 df AS (SELECT word, count(DISTINCT id) AS df FROM hits GROUP BY word),
 bm AS (SELECT h.query_id, h.id, round(sum(ln(1 + (st.nd - d.df + 0.5) / (d.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / st.al))), 9) AS score FROM hits h JOIN df d ON d.word = h.word CROSS JOIN st GROUP BY h.query_id, h.id
  QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY round(sum(ln(1 + (st.nd - d.df + 0.5) / (d.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / st.al))), 9) DESC, h.id) <= 200)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """All search queries, with vectors and words."""
    return table(spark, sf, "search_queries").select("query_id", F.col("query_embedding").alias("vector"), F.split("query_text", " ").alias("words"))


@query(f"WITH {SCOPED.format(extra='')}, {SOUND}, {NEAR} SELECT query_id, id AS chunk_id, round(similarity, 6) AS similarity FROM near")
def semantic_nearest(spark, sf):
    near = nearest_each(scoped_chunks(Corpus.load(spark, sf)), _asked(spark, sf))
    return near.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").alias("chunk_id"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {SCOPED.format(extra='')}, {HITS} SELECT query_id, id AS chunk_id, round(score, 6) AS score FROM bm")
def semantic_bm25(spark, sf):
    best = bm25_each(scoped_chunks(Corpus.load(spark, sf)), _asked(spark, sf))
    return best.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


@query(f"WITH {SCOPED.format(extra='')}, {HITS} SELECT query_id, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_text FROM bm")
def semantic_leg_ranks(spark, sf):
    ranked = leg_rank(bm25_each(scoped_chunks(Corpus.load(spark, sf)), _asked(spark, sf)), "score", "rank_text", "query_id")
    return ranked.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").alias("chunk_id"), "rank_text")


FUSED = """v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rv FROM near), t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rt FROM bm),
fused AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, coalesce(1.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rt), 0) AS rrf FROM v FULL OUTER JOIN t ON v.id = t.id AND v.query_id = t.query_id)"""
TOP = "SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) <= 10"


@query(f"WITH {SCOPED.format(extra='')}, {SOUND}, {NEAR}, {HITS}, {FUSED} SELECT query_id, id AS chunk_id, round(CAST(rrf AS DOUBLE), 6) AS rrf_score FROM fused")
def semantic_rrf(spark, sf):
    chunks, asked = scoped_chunks(Corpus.load(spark, sf)), _asked(spark, sf)
    out = fuse(nearest_each(chunks, asked), bm25_each(chunks, asked), None, ("query_id",))
    return out.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").alias("chunk_id"), F.round("rrf_score", 6).alias("rrf_score"))


@query(
    f"WITH {SCOPED.format(extra='')}, {SOUND}, {NEAR}, {HITS}, {FUSED} SELECT f.query_id, f.id AS chunk_id, round(CAST(f.rrf AS DOUBLE), 6) AS rrf_score, round(list_cosine_similarity(s.e, CAST(q.query_embedding AS DOUBLE[])), 6) AS similarity FROM ({TOP}) f JOIN search_queries q ON q.query_id = f.query_id LEFT JOIN sound s ON s.id = f.id"
)
def semantic_hybrid(spark, sf):
    out = hybrid_each(Corpus.load(spark, sf), _asked(spark, sf))
    return out.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").alias("chunk_id"), F.round("rrf_score", 6).alias("rrf_score"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {SCOPED.format(extra=GO_PKG)}, {SOUND}, {NEAR}, {HITS}, {FUSED} SELECT query_id, id AS chunk_id, round(CAST(rrf AS DOUBLE), 6) AS rrf_score FROM ({TOP})")
def semantic_filtered(spark, sf):
    # the filters as a caller writes them; the words and vectors are those of the search queries
    filters = split_prose("lang:go file:^pkg/ anything")
    out = hybrid_each(Corpus.load(spark, sf), _asked(spark, sf), filters)
    return out.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").alias("chunk_id"), F.round("rrf_score", 6).alias("rrf_score"))


@query(f"""WITH sound AS MATERIALIZED (SELECT id, file_id, chunk_index, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE {USABLE})
    SELECT a.id AS chunk_id, b.id AS next_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM sound a JOIN sound b ON b.file_id = a.file_id AND b.chunk_index = a.chunk_index + 1""")
def semantic_similarity(spark, sf):
    """How alike every two neighbouring chunks of a file are."""
    c = Corpus.load(spark, sf)
    sound = c.chunks.where(usable_vector(F.col("embedding"), 128)).select("id", "file_id", "chunk_index", "embedding")
    after = sound.select(F.col("id").alias("next_id"), "file_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("embedding").alias("next"))
    return sound.join(after, ["file_id", "chunk_index"]).select(F.col("id").alias("chunk_id"), "next_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


# --- scalar functions over whole tables -------------------------------------------------------------------------------


@query("SELECT id AS file_id, sha256(coalesce(content, '')) AS sha, sha256(coalesce(content, '')) = content_sha AS agrees FROM files")
def text_sha(spark, sf):
    sha = content_sha(F.col("content"))
    return Corpus.load(spark, sf).files.select(F.col("id").alias("file_id"), sha.alias("sha"), (sha == F.col("content_sha")).alias("agrees"))


@query(
    """SELECT id AS file_id, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.rs' THEN 'rust' END AS lang FROM files"""
)
def text_language(spark, sf):
    return Corpus.load(spark, sf).files.select(F.col("id").alias("file_id"), language(F.col("path")).alias("lang"))


@query("SELECT id AS file_id, len(string_split(content, chr(10))) AS n_lines, strlen(content) AS n_bytes, list_max(list_transform(string_split(content, chr(10)), lambda x: length(regexp_replace(x, '\\r$', '')))) AS longest FROM files WHERE content IS NOT NULL")
def text_lines(spark, sf):
    files = Corpus.load(spark, sf).files.where("content IS NOT NULL")
    ls = lines(F.col("content"))
    return files.select(F.col("id").alias("file_id"), F.size(ls).cast("long").alias("n_lines"), F.octet_length("content").cast("long").alias("n_bytes"), F.array_max(F.transform(ls, F.length)).cast("long").alias("longest"))


@query("SELECT id AS repo_id, name FROM repos WHERE name GLOB 'p*/*-core' OR name GLOB '[a-d]*/*kit'")
def glob_repos(spark, sf):
    repos = Corpus.load(spark, sf).repos
    return repos.where(F.col("name").rlike(glob_pattern("p*/*-core")) | F.col("name").rlike(glob_pattern("[a-d]*/*kit"))).select(F.col("id").alias("repo_id"), "name")


@query(f"SELECT f.id AS file_id {FROM} WHERE {ON_DEFAULT} AND NOT list_contains(f.branches, 'main')")
def default_branch_files(spark, sf):
    c = Corpus.load(spark, sf)
    r = c.repos.select(F.col("id").alias("repo_id"), "default_branch")
    return c.files.join(r, "repo_id").where(has_branch(default_branch(F.col("default_branch"))) & ~has_branch("main")).select(F.col("id").alias("file_id"))


# --- ingest and index -------------------------------------------------------------------------------------------------

# A delivery: every repository's ``develop`` files come as its ``main`` snapshot, those without a language under new paths.
INCOMING = """incoming AS (SELECT DISTINCT repo_id, 'main' AS branch, CASE WHEN lang IS NULL THEN 'moved/' || path ELSE path END AS path, content_sha FROM files WHERE list_contains(branches, 'develop'))"""


def _incoming(c: Corpus) -> DataFrame:
    f = c.files.where(has_branch("develop"))
    path = F.when(F.col("lang").isNull(), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    rows = f.select("repo_id", F.lit("main").alias("branch"), path.alias("path"), "lang", "size", "content", "commit", "content_sha", F.col("id").cast("long").alias("ord"))
    return idx.last_of_each(rows)


STORED = "stored AS (SELECT repo_id, path, content_sha, list_sort(list_distinct(flatten(list(branches)))) AS branches FROM files GROUP BY 1, 2, 3)"


def _stored(c: Corpus) -> DataFrame:
    one = F.struct("id", "lang", "size", "content", "commit")
    rows = c.files.groupBy("repo_id", "path", "content_sha").agg(F.min_by(one, "id").alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("branches")))).alias("branches"))
    return rows.select("r.id", "repo_id", "path", "r.lang", "r.size", "r.content", "r.commit", "content_sha", "branches")


@query(
    f"""WITH {INCOMING}, {STORED}, v AS (SELECT max(index_semantics_version) AS v FROM repo_branches),
    g AS (SELECT repo_id, branch, coalesce(index_semantics_version = v.v, false) AS own, bool_and(coalesce(index_semantics_version = v.v, false)) OVER (PARTITION BY repo_id) AS every FROM repo_branches, v)
    SELECT i.repo_id AS repo_id, i.path AS path, i.content_sha AS content_sha, CASE WHEN s.branches IS NULL OR NOT coalesce(g.own, false) THEN 'changed' WHEN list_contains(s.branches, 'main') THEN 'carried' WHEN g.every THEN 'membership' ELSE 'changed' END AS class
    FROM incoming i LEFT JOIN stored s ON s.repo_id = i.repo_id AND s.path = i.path AND s.content_sha = i.content_sha LEFT JOIN g ON g.repo_id = i.repo_id AND g.branch = i.branch"""
)
def index_classify(spark, sf):
    c = Corpus.load(spark, sf)
    version = c.repo_branches.agg(F.max("index_semantics_version")).first()[0]
    return idx.classify(_incoming(c), c.files, idx.gates(c.repo_branches, version)).select("repo_id", "path", "content_sha", "class")


# The delivered row of a key is the last, the stored one the first; a delivered row replaces the attributes.
FULL = f"""{INCOMING}, {STORED}, inew AS (SELECT * FROM (SELECT repo_id, CASE WHEN lang IS NULL THEN 'moved/' || path ELSE path END AS path, content_sha, lang, size, content, commit,
   row_number() OVER (PARTITION BY repo_id, CASE WHEN lang IS NULL THEN 'moved/' || path ELSE path END, content_sha ORDER BY id DESC) AS k FROM files WHERE list_contains(branches, 'develop')) WHERE k = 1),
 sold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, content_sha ORDER BY id) AS k FROM files) WHERE k = 1),
 merged AS (SELECT coalesce(s.repo_id, i.repo_id) AS repo_id, coalesce(s.path, i.path) AS path, coalesce(s.content_sha, i.content_sha) AS content_sha, i.path IS NOT NULL AS delivered,
  list_sort(list_distinct(list_concat(coalesce(s.branches, []), CASE WHEN i.branch IS NULL THEN [] ELSE [i.branch] END))) AS branches FROM stored s FULL OUTER JOIN incoming i ON s.repo_id = i.repo_id AND s.path = i.path AND s.content_sha = i.content_sha),
 attrs AS (SELECT m.*, CASE WHEN m.delivered THEN n.lang ELSE o.lang END AS lang, CASE WHEN m.delivered THEN n.size ELSE o.size END AS size, CASE WHEN m.delivered THEN n.commit ELSE o.commit END AS commit, CASE WHEN m.delivered THEN n.content ELSE o.content END AS content, o.id AS old_id
  FROM merged m LEFT JOIN inew n ON n.repo_id = m.repo_id AND n.path = m.path AND n.content_sha = m.content_sha LEFT JOIN sold o ON o.repo_id = m.repo_id AND o.path = m.path AND o.content_sha = m.content_sha)"""
ROW = "repo_id, path, content_sha, array_to_string(branches, ',') AS branches, lang, size, commit, content, CAST(old_id AS BIGINT) AS old_id"


def _rows(files: DataFrame) -> DataFrame:
    """Full rows; the ids of new ones are hashes, which lie far beyond those of the tables."""
    old = F.when(F.col("id").between(0, 2**31 - 1), F.col("id"))
    return files.select("repo_id", "path", "content_sha", F.array_join("branches", ",").alias("branches"), "lang", "size", "commit", "content", old.alias("old_id"))


@query(f"WITH {FULL} SELECT {ROW} FROM attrs")
def index_merge(spark, sf):
    c = Corpus.load(spark, sf)
    return _rows(idx.merge_files(_stored(c), _incoming(c)))


@query(
    f"""WITH {FULL}, swept AS (SELECT a.* REPLACE (CASE WHEN a.repo_id IN (SELECT repo_id FROM incoming) AND NOT a.delivered THEN list_filter(a.branches, lambda b: b <> 'main') ELSE a.branches END AS branches) FROM attrs a)
    SELECT {ROW} FROM swept WHERE len(branches) > 0"""
)
def index_sweep(spark, sf):
    c = Corpus.load(spark, sf)
    new = _incoming(c)
    stored = _stored(c)
    return _rows(idx.apply_changes(stored, new, idx.file_changes(stored, new, whole_branches=True)))


STAMPED = "SELECT b.repo_id, b.branch, r.last_indexed_commit AS commit, CASE WHEN b.id % 3 = 0 THEN 0 ELSE 5 END AS parsed FROM repo_branches b JOIN repos r ON r.id = b.repo_id WHERE b.branch = coalesce(r.default_branch, 'HEAD')"


@query(
    f"""WITH n AS ({STAMPED} UNION ALL SELECT id, 'new', 'cafe', 1 FROM repos) SELECT coalesce(s.repo_id, n.repo_id) AS repo_id, coalesce(s.branch, n.branch) AS branch, CASE WHEN n.branch IS NOT NULL THEN n.commit ELSE s.last_indexed_commit END AS commit,
    CAST(CASE WHEN n.parsed > 0 OR s.branch IS NULL THEN 99 ELSE s.index_semantics_version END AS INTEGER) AS version FROM repo_branches s FULL OUTER JOIN n ON n.repo_id = s.repo_id AND n.branch = s.branch"""
)
def index_next_stamps(spark, sf):
    c = Corpus.load(spark, sf)
    r = c.repos.select(F.col("id").alias("repo_id"), "default_branch", F.col("last_indexed_commit").alias("commit"))
    n = c.repo_branches.join(r, "repo_id").where(F.col("branch") == default_branch(F.col("default_branch"))).select("repo_id", "branch", "commit", F.when(F.col("id") % 3 == 0, 0).otherwise(5).alias("parsed"))
    n = n.unionByName(r.select("repo_id", F.lit("new").alias("branch"), F.lit("cafe").alias("commit"), F.lit(1).alias("parsed")))
    return idx.next_stamps(c.repo_branches, n, 99).select("repo_id", "branch", F.col("last_indexed_commit").alias("commit"), F.col("index_semantics_version").alias("version"))


@query("SELECT c.id AS symbol_id, c.file_id AS file_id FROM symbols c WHERE c.file_id NOT IN (SELECT id FROM files WHERE lang = 'go') UNION ALL SELECT -id AS symbol_id, id AS file_id FROM files WHERE lang = 'go' AND content IS NOT NULL")
def index_children(spark, sf):
    c = Corpus.load(spark, sf)
    changed = c.files.where("lang = 'go'")
    new = changed.where("content IS NOT NULL").select((-F.col("id")).alias("id"), F.col("id").alias("file_id"))
    return idx.replace_children(c.symbols.select("id", "file_id"), new, changed).select(F.col("id").alias("symbol_id"), "file_id")


@query("SELECT f.repo_id AS repo_id, b AS branch, count(*) AS chunks FROM (SELECT id, repo_id, unnest(branches) AS b FROM files) f JOIN chunks c ON c.file_id = f.id GROUP BY 1, 2 HAVING count(*) > 20")
def index_degraded(spark, sf):
    c = Corpus.load(spark, sf)
    return idx.degraded_branches(c.chunks, c.files, 20)


CHUNK = "id AS chunk_id, file_id, chunk_index, content"


@query(f"WITH go AS (SELECT id FROM files WHERE lang = 'go'), rs AS (SELECT id FROM files WHERE lang = 'rust') SELECT {CHUNK} FROM chunks WHERE file_id NOT IN (SELECT id FROM rs) AND (file_id NOT IN (SELECT id FROM go) OR chunk_index = 0)")
def index_chunk_sink(spark, sf):
    """Chunks after a delivery of all go files, twice, the second time cut to their first chunk, and of rust files without any."""
    c = Corpus.load(spark, sf)
    files = c.files.where("lang IN ('go', 'rust')").select(F.col("id").alias("file_id"), "lang")
    one = F.struct("id", "chunk_index", "content")
    rows = files.join(c.chunks.groupBy("file_id").agg(F.collect_list(one).alias("all")), "file_id", "left")
    first = rows.select("file_id", F.lit(1).alias("ord"), F.col("all").alias("chunks"))
    cut = F.when(F.col("lang") == "go", F.filter("all", lambda x: x["chunk_index"] == 0))
    second = rows.select("file_id", F.lit(2).alias("ord"), F.coalesce(cut, F.slice("all", 1, 0)).alias("chunks"))
    out = idx.sink_chunks(c.chunks.select("id", "file_id", "chunk_index", "content"), first.unionByName(second))
    return out.select(F.col("id").alias("chunk_id"), "file_id", "chunk_index", "content")


@query("SELECT f.id AS file_id, sha256(coalesce(f.content, '')) AS sha, array_to_string(CASE WHEN f.lang = 'go' THEN [coalesce(r.default_branch, 'HEAD')] ELSE f.branches END, ',') AS branches FROM files f JOIN repos r ON r.id = f.repo_id")
def migrate_files(spark, sf):
    """Files whose shas, and branches of go files, are lost, filled in again."""
    c = Corpus.load(spark, sf)
    old = c.files.drop("content_sha").withColumn("branches", F.when(~F.col("lang").eqNullSafe("go"), F.col("branches")))
    out = mig.backfill_branches(mig.backfill_shas(old), c.repos)
    return out.select(F.col("id").alias("file_id"), F.col("content_sha").alias("sha"), F.array_join("branches", ",").alias("branches"))


@query(
    """SELECT repo_id, branch, last_indexed_commit AS commit FROM repo_branches WHERE branch <> 'main' UNION ALL
    SELECT id, coalesce(default_branch, 'HEAD'), last_indexed_commit FROM repos r WHERE NOT EXISTS (SELECT 1 FROM repo_branches b WHERE b.branch <> 'main' AND b.repo_id = r.id AND b.branch = coalesce(r.default_branch, 'HEAD'))"""
)
def migrate_stamps(spark, sf):
    c = Corpus.load(spark, sf)
    out = mig.seed_stamps(c.repos, c.repo_branches.where("branch <> 'main'"))
    return out.select("repo_id", "branch", F.col("last_indexed_commit").alias("commit"))


@query("SELECT repo_id, path, count(*) AS versions FROM files GROUP BY 1, 2 HAVING count(*) > 1")
def multi_version_paths(spark, sf):
    return mig.multi_version_paths(Corpus.load(spark, sf).files)


@query("SELECT id AS stamp_id FROM repo_branches WHERE last_indexed_at >= (SELECT max(last_indexed_at) FROM repo_branches) - INTERVAL 48 HOURS")
def indexed_within(spark, sf):
    c = Corpus.load(spark, sf)
    latest = c.repo_branches.agg(F.max("last_indexed_at")).first()[0]
    return mig.indexed_within(c.repo_branches, 48, F.lit(latest)).select(F.col("id").alias("stamp_id"))


NEVER = "SELECT repo_id, branch FROM repo_branches WHERE last_indexed_commit IS NULL"


@query(
    f"""WITH gone AS (SELECT repo_id, list(branch) AS g FROM ({NEVER}) GROUP BY repo_id),
    kept AS (SELECT f.id, CASE WHEN g.g IS NULL THEN f.branches ELSE list_filter(f.branches, lambda b: NOT list_contains(g.g, b)) END AS branches FROM files f LEFT JOIN gone g ON g.repo_id = f.repo_id)
    SELECT id AS file_id, array_to_string(branches, ',') AS branches FROM kept WHERE len(branches) > 0"""
)
def index_retire_files(spark, sf):
    c = Corpus.load(spark, sf)
    gone = c.repo_branches.where("last_indexed_commit IS NULL")
    return idx.retire(c.files, c.repo_branches, gone)[0].select(F.col("id").alias("file_id"), F.array_join("branches", ",").alias("branches"))


@query("SELECT id AS stamp_id, repo_id, branch FROM repo_branches WHERE (repo_id, branch) NOT IN (" + NEVER + ")")
def index_retire_stamps(spark, sf):
    c = Corpus.load(spark, sf)
    return idx.retire(c.files, c.repo_branches, c.repo_branches.where("last_indexed_commit IS NULL"))[1].select(F.col("id").alias("stamp_id"), "repo_id", "branch")


@query("SELECT s.id AS symbol_id, s.file_id AS file_id FROM symbols s WHERE s.repo_id IN (SELECT id FROM repos WHERE default_branch IS NOT NULL) AND s.file_id IN (SELECT id FROM files WHERE repo_id IN (SELECT id FROM repos WHERE default_branch IS NOT NULL))")
def index_purge_symbols(spark, sf):
    c = Corpus.load(spark, sf)
    keep = c.repos.where("default_branch IS NOT NULL").select(F.col("id").alias("repo_id"))
    left = idx.cascade(idx.purge(c.symbols, keep), idx.purge(c.files, keep))
    return left.select(F.col("id").alias("symbol_id"), "file_id")


@query(
    """WITH v AS (SELECT max(index_semantics_version) AS v FROM repo_branches), heads AS (SELECT b.repo_id, b.branch, r.last_indexed_commit AS commit FROM repo_branches b JOIN repos r ON r.id = b.repo_id)
    SELECT h.* FROM heads h WHERE NOT EXISTS (SELECT 1 FROM repo_branches b, v WHERE b.repo_id = h.repo_id AND b.branch = h.branch AND b.last_indexed_commit = h.commit AND b.index_semantics_version = v.v)"""
)
def index_work_list(spark, sf):
    c = Corpus.load(spark, sf)
    version = c.repo_branches.agg(F.max("index_semantics_version")).first()[0]
    r = c.repos.select(F.col("id").alias("repo_id"), F.col("last_indexed_commit").alias("commit"))
    return idx.work_list(c.repo_branches.select("repo_id", "branch").join(r, "repo_id").select("repo_id", "branch", "commit"), c.repo_branches, version)


@query("SELECT repo_id FROM repo_branches GROUP BY repo_id HAVING bool_and(coalesce(index_semantics_version = (SELECT max(index_semantics_version) FROM repo_branches), false))")
def index_current_repos(spark, sf):
    c = Corpus.load(spark, sf)
    return idx.current_repos(c.repo_branches, c.repo_branches.agg(F.max("index_semantics_version")).first()[0])


@query(
    """WITH b AS (SELECT b.repo_id, b.branch, b.branch = coalesce(r.default_branch, 'HEAD') AS first FROM repo_branches b JOIN repos r ON r.id = b.repo_id WHERE b.branch = coalesce(r.default_branch, 'HEAD') OR b.branch GLOB 'release-*' OR b.branch GLOB 'feature/*')
    SELECT repo_id, branch, n <= 2 AS complete FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY first DESC, branch) AS k, count(*) OVER (PARTITION BY repo_id) AS n FROM b) WHERE k <= 2"""
)
def branch_choice(spark, sf):
    c = Corpus.load(spark, sf)
    r = c.repos.select(F.col("id").alias("repo_id"), "default_branch")
    return choose_branches(c.repo_branches.join(r, "repo_id"), ["release-*", "feature/*"], 2)


LISTED = "listed AS (SELECT name, id AS ord FROM repos UNION ALL SELECT upper(name), id + 100000 FROM repos)"


@query(f"WITH {LISTED} SELECT min_by(name, ord) AS name, min(ord) AS ord FROM listed WHERE NOT name GLOB '*-svc' GROUP BY lower(name)")
def repo_choice(spark, sf):
    r = Corpus.load(spark, sf).repos
    more = {"fork": F.lit(False), "archived": F.lit(False), "branches": F.array(F.lit("main"))}
    listed = r.select("name", F.col("id").alias("ord")).unionByName(r.select(F.upper("name").alias("name"), (F.col("id") + 100000).alias("ord"))).withColumns(more)
    return choose_repos(listed, ["*-svc"])[0].select("name", "ord")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark, sf):
    return event_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("SELECT gram, count(*) AS files FROM (SELECT DISTINCT id, unnest(list_transform(range(1, length(lower(content)) - 1), lambda i: substr(lower(content), i, 3))) AS gram FROM files WHERE length(content) >= 3) GROUP BY gram")
def trigram_table(spark, sf):
    return tri.build(Corpus.load(spark, sf).files).groupBy("gram").agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT {FILE_ROW} {FROM} WHERE contains(lower(f.content), 'sorted(') AND {ON_DEFAULT}")
def trigram_search(spark, sf):
    c = Corpus.load(spark, sf)
    node = parse('"sorted("')
    return select_files(tri.narrow(c, tri.build(c.files), node), node).select(F.col("id").alias("file_id"), "repo_id", "path")


# Extraction and chunking have no SQL: they are tested on fixtures and against the tables' own rows.


@query()
def extract_symbols(spark, sf):
    return symbols_of(extract_files(spread(table(spark, sf, "files").select("id", "lang", "content"))))


@query()
def extract_edges(spark, sf):
    return edges_of(extract_files(spread(table(spark, sf, "files").select("id", "lang", "content"))))


@query()
def chunk_lines(spark, sf):
    return chunk_files(spread(table(spark, sf, "files").select("id", "content")))


@query("SELECT id AS file_id, content, true AS within_limit, true AS lines_follow FROM files WHERE content <> ''")
def chunks_rejoined(spark, sf):
    """Every file put together again from its chunks, whether these keep the limit (but for single lines) and their lines
    follow on each other."""
    c = chunk_files(spread(table(spark, sf, "files").select("id", "content")))
    each = F.struct("chunk_index", "content", "start_line", "end_line")
    parts = c.groupBy("file_id").agg(F.sort_array(F.collect_list(each)).alias("p"))
    fits = F.forall("p", lambda x: (F.length(x["content"]) <= 2000) | (x["start_line"] == x["end_line"]))
    ends = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["end_line"]))
    follow = F.forall(F.zip_with("p", F.slice(ends, F.lit(1), F.size("p")), lambda x, e: x["start_line"] == e + 1), lambda ok: ok)
    return parts.select("file_id", F.array_join(F.transform("p", lambda x: x["content"]), "").alias("content"), fits.alias("within_limit"), follow.alias("lines_follow"))


@query()
def embed_contents(spark, sf):
    return embed_chunks(chunk_files(spread(table(spark, sf, "files").select("id", "content"))), hash_embedder(), 128).select("file_id", "chunk_index", "embedding")
