"""Bounded answers for callers: payloads, cursors, byte budgets and time limits over the relational operators.

Everything a caller can get wrong comes back as a field of the payload, not as an exception. Results are pages of at most
1000 rows; only such pages reach the driver.
"""

from __future__ import annotations

import base64
import binascii
import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import SparkSession, functions as F

from .functions.chunks import hash_embedder
from .functions.search_vector import words
from .operators import references as ref
from .operators.grep import Matchers, compile_all, match_lines
from .operators.search import commit_mood, get_file, list_repos, resolve_commits
from .operators.semantic import hybrid
from .operators.symbols import find_symbols, ordered_symbols, symbol_patterns
from .plans.corpus import FILE_ORDER, Corpus, page, select_files
from .plans.language import Node, QueryError, UnsupportedAtom, affirmative, case_of, parse, split_prose, with_sugar
from .plans.regex_dialect import BadPattern


@dataclass(frozen=True)
class Limits:
    #: Default and largest page, bytes of content scanned, of an answer, its floor, and times in seconds.
    rows: int = 200
    most_rows: int = 1000
    content_bytes: int = 8 * 1024 * 1024
    response_bytes: int = 100_000
    least_response_bytes: int = 1024
    statement_s: float = 5.0
    match_s: float = 2.0
    concurrency: int = 5

    def clamp(self, limit: int | None) -> int:
        return self.rows if limit is None or limit <= 0 else min(limit, self.most_rows)

    def budget(self, asked: int | None) -> int:
        """A caller may lower the budget, down to the floor, and never raise it."""
        return self.response_bytes if asked is None else max(self.least_response_bytes, min(asked, self.response_bytes))


class BadCursor(ValueError):
    pass


def encode_cursor(repo_id: int, path: str, sha: str, row_id: int | None = None) -> str:
    more = {} if row_id is None else {"i": row_id}
    raw = json.dumps({"v": 1, "r": repo_id, "p": path, "s": sha, **more}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(text: str) -> tuple:
    try:
        d = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        ok = d["v"] == 1 and type(d["r"]) is int and isinstance(d["p"], str) and isinstance(d["s"], str) and type(d.get("i", 0)) is int
    except (ValueError, KeyError, TypeError, binascii.Error):
        ok = False
    if not ok:
        raise BadCursor("not a cursor of this service")
    return (d["r"], d["p"], d["s"], d["i"]) if "i" in d else (d["r"], d["p"], d["s"])


class TooSlow(RuntimeError):
    pass


def within(spark: SparkSession, seconds: float, work: Callable):
    """``work()`` in a job group that is cancelled after ``seconds``."""
    group = f"sourcelume-{threading.get_ident()}-{time.monotonic_ns()}"
    fired = threading.Event()

    def stop():
        fired.set()
        # jobs that the work has yet to start as well
        spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "bounded statement", interruptOnCancel=True)
    timer.start()
    try:
        out = work()
    except Exception as e:
        if fired.is_set():
            raise TooSlow(f"stopped after {seconds} s") from e
        raise
    else:
        if fired.is_set():
            raise TooSlow(f"took more than {seconds} s")
        return out
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _ahead(rows: Iterator) -> Iterator:
    """``rows`` with the first of them fetched."""
    first = next(rows, None)
    return iter(()) if first is None else chain([first], rows)


def is_bad_pattern(e: Exception) -> bool:
    return isinstance(e, BadPattern) or "PATTERN" in str(getattr(e, "getCondition", lambda: "")() or "") or "PatternSyntaxException" in str(e)


def measured(payload: dict) -> int:
    return len(json.dumps(payload))


def trim_list(payload: dict, key: str, budget: int, least: int = 0) -> dict:
    """``payload`` with the tail of its list cut until its JSON fits; ``least`` entries stay."""
    items = payload[key]
    if measured(payload) <= budget:
        return payload
    lo, hi = least, len(items)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if measured({**payload, key: items[:mid], "truncated": True}) <= budget:
            lo = mid
        else:
            hi = mid - 1
    return {**payload, key: items[:lo], "truncated": True, "truncation_reason": "response_bytes"}


@dataclass
class Service:
    spark: SparkSession
    corpus: Corpus
    limits: Limits = field(default_factory=Limits)
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    semantic_enabled: bool = True

    def __post_init__(self):
        self._slots = threading.Semaphore(self.limits.concurrency)

    def _timed(self, work: Callable):
        """``work()`` within the time a statement may take."""
        return within(self.spark, self.limits.statement_s, work)

    def _bounded(self, out: dict, work: Callable[[], dict]) -> dict:
        """The answer of ``work`` in one of the slots; ``out`` with ``query_too_broad`` if a statement took too long."""
        with self._slots:
            try:
                return work()
            except TooSlow:
                return {**out, "query_too_broad": True}

    # --- search -------------------------------------------------------------------------------------------------------

    def search(self, query: str, limit: int | None = None, branch: str | None = None, commit: str | None = None, cursor: str | None = None, paged: bool = False, budget: int | None = None) -> dict:
        began = time.monotonic()
        out: dict = {
            "query": query, "file_count": 0, "match_count": 0, "duration_ns": 0, "files": [], "truncated": False, "truncation_reason": None, "regex_incompatible": False,
            "regex_invalid": False, "query_too_broad": False, "query_parse_error": None, "no_content_atom": False, "zero_width_only_atoms": False,
        }
        text = with_sugar(query, branch, commit)
        with self._slots:
            try:
                at = decode_cursor(cursor) if cursor else None
                node = parse(text)
                self._search(out, node, case_of(text), self.limits.clamp(limit), at, paged or cursor is not None)
            except QueryError as e:
                out["query_parse_error"] = {"message": e.message, "position": e.position}
            except BadCursor as e:
                out["query_parse_error"] = {"message": str(e), "position": 0}
            except TooSlow:
                out["query_too_broad"] = True
            except Exception as e:
                if not is_bad_pattern(e):
                    raise
                out["regex_invalid"] = True
        out["duration_ns"] = int((time.monotonic() - began) * 1e9)
        return self._fit_search(out, self.limits.budget(budget), paged or cursor is not None)

    def _search(self, out: dict, node: Node, sensitive: bool, limit: int, at: tuple | None, paged: bool) -> None:
        mood = commit_mood(node)
        resolved = {}
        if mood != "none":
            found = resolve_commits(self.corpus, [t.value for t in affirmative(node, "commit")]).orderBy("repo", "branch").limit(self.limits.most_rows + 1)
            rows = self._timed(found.collect)
            out["resolved_truncated"] = len(rows) > self.limits.most_rows
            rows = rows[: self.limits.most_rows]
            out["resolved"] = [{"repo": r["repo"], "branch": r["branch"], "commit": r["commit"], "last_indexed_at": r["last_indexed_at"] and r["last_indexed_at"].isoformat()} for r in rows]
            if not rows:
                out["commit_not_indexed"] = True
                return
            if mood == "bare":
                return
            for r in rows:
                resolved.setdefault(r["repo_id"], r["branch"])
        m = Matchers.of(node)
        out["regex_incompatible"], out["no_content_atom"], out["zero_width_only_atoms"] = m.regex_incompatible, m.no_content_atom, m.zero_width_only
        selected = select_files(self.corpus, node, sensitive)
        keys = page(selected.select(*FILE_ORDER), limit, at)
        files = selected.join(F.broadcast(keys.select("id")), "id", "left_semi").orderBy(*FILE_ORDER)
        entries: dict[tuple, dict] = {}
        consumed = last = None
        stopped = None
        if m.patterns:
            rows = self._timed(lambda: keys.orderBy(*FILE_ORDER).collect())
            used, deadline = 0, time.monotonic() + self.limits.match_s
            compiled = compile_all(m.patterns)
            for f in self._timed(lambda: _ahead(files.toLocalIterator(prefetchPartitions=False))) if rows else ():
                content = f["content"] or ""
                if used + len(content) > self.limits.content_bytes:
                    stopped = "byte_cap"
                    break
                if time.monotonic() > deadline:
                    stopped = "match_budget"
                    break
                used += len(content.encode("utf-8", "surrogatepass"))
                last = (f["repo_id"], f["path"], f["content_sha"])
                consumed = (*last, f["id"])
                try:
                    found = list(match_lines(content, compiled, max(0.01, deadline - time.monotonic())))
                except TimeoutError:
                    stopped = "match_budget"
                    break
                if found:
                    entries[last] = self._entry(f, [{"line": n, "text": t, "byte_ranges": s} for n, t, s in found])
            full = len(rows) >= limit
            if paged:
                # out of time before the first file of a page: the same cursor is worth another try; a first file that is
                # beyond the byte cap would be so again, so there the pages end
                retry = at if stopped == "match_budget" and consumed is None else None
                on = consumed if stopped or full else None
                out["next_cursor"] = encode_cursor(*(on or retry)) if on or retry else None
            elif not stopped and full:
                stopped = "row_cap"
        elif paged:
            out["next_cursor"] = None
        if symbol_patterns(node) and at is None:
            defs = self._timed(ordered_symbols(find_symbols(self.corpus, node, selected), limit).collect)
            for d in defs:
                e = entries.setdefault((d["repo_id"], d["path"], d["content_sha"]), self._entry(d, []))
                e["matches"].append({"line": d["start_line"], "text": None, "byte_ranges": [], "symbols": [{"name": d["name"], "kind": d["kind"], "start_line": d["start_line"], "end_line": d["end_line"]}]})
            if defs:
                out["no_content_atom"] = out["zero_width_only_atoms"] = False
        wanted = [t.value for t in affirmative(node, "branch")]
        for (repo_id, _, _), e in sorted(entries.items()):
            e["matches"].sort(key=lambda x: (x["line"] is None, x["line"] or 0))
            both = sorted(set(e["branches"]) & set(wanted)) or sorted(e["branches"])
            e["permalink_branch"] = resolved.get(repo_id) or (both[0] if wanted and both else None)
            out["files"].append(e)
            out["match_count"] += sum(max(1, len(x["byte_ranges"])) for x in e["matches"])
        out["file_count"] = len(out["files"])
        if stopped:
            out["truncated"], out["truncation_reason"] = True, stopped

    @staticmethod
    def _entry(f, matches: list[dict]) -> dict:
        return {"repo": f["repo_name"], "repo_id": f["repo_id"], "file": f["path"], "language": f["lang"], "branches": list(f["branches"]), "matches": matches, "content_sha": f["content_sha"], "id": f["id"] if "id" in f else f["file_id"], "permalink_branch": None}

    def _fit_search(self, out: dict, budget: int, paged: bool) -> dict:
        """The answer without what only internal callers need, cut to the budget; at least one file stays, and a cut page
        gets the cursor of its last file."""
        lean = {k: v for k, v in out.items() if k != "duration_ns"}
        full = out["files"]
        lean["files"] = [{k: v for k, v in e.items() if k not in ("content_sha", "repo_id", "id")} | {"matches": [{k: v for k, v in x.items() if k != "byte_ranges"} for x in e["matches"]]} for e in full]
        cut = trim_list(lean, "files", budget, 1 if full else 0)
        if len(cut["files"]) < len(full):
            cut["file_count"] = len(cut["files"])
            last = full[len(cut["files"]) - 1]
            if paged:
                cut["next_cursor"] = encode_cursor(last["repo_id"], last["file"], last["content_sha"], last["id"])
        return cut

    # --- others -------------------------------------------------------------------------------------------------------

    def semantic(self, query: str, k: int = 10, branch: str | None = None) -> dict:
        out: dict = {"query": query, "results": [], "disabled": False, "semantic_schema_missing": False, "unsupported_filter": None, "query_parse_error": None, "nothing_to_embed": False, "query_too_broad": False}
        if not self.semantic_enabled:
            return {**out, "disabled": True}
        if not {"embedding", "ts", "file_id"} <= set(self.corpus.chunks.columns):
            return {**out, "semantic_schema_missing": True}
        try:
            q = split_prose(query)
        except UnsupportedAtom as e:
            return {**out, "unsupported_filter": {"atom": e.atom, "position": e.position}}
        except QueryError as e:
            return {**out, "query_parse_error": {"message": e.message, "position": e.position}}
        if not q.prose:
            return {**out, "nothing_to_embed": True}
        vector = (self.embedder or hash_embedder())([q.prose])[0]
        # words as they are, for search vectors of plain words, and their stems, for those that ingest makes
        terms = sorted({*q.prose.lower().split(), *(w for w, _ in words(q.prose))})

        def work() -> dict:
            try:
                rows = self._timed(hybrid(self.corpus, vector, terms, q, branch, min(max(1, k), self.limits.most_rows)).orderBy(F.desc("rrf_score"), "id").collect)
            except Exception as e:
                if not is_bad_pattern(e):
                    raise
                return {**out, "query_parse_error": {"message": "invalid pattern", "position": 0}}
            fields = ("repo", "chunk_index", "content", "start_line", "end_line", "rrf_score", "similarity")
            return {**out, "results": [{"file": r["path"], **{c: r[c] for c in fields}} for r in rows]}

        return self._bounded(out, work)

    def repos(self, after: str | None = None) -> list[dict]:
        """Repositories in order of their names, a page of the most rows a page may have, those past ``after``."""
        listed = list_repos(self.corpus)
        listed = listed if after is None else listed.where(F.col("repo") > after)
        with self._slots:
            rows = self._timed(listed.orderBy("repo").limit(self.limits.most_rows).collect)
        return [{"repo": r["repo"], "default_branch": r["default_branch"], "branches": list(r["branches"]), "commit": r["commit"], "last_indexed_at": r["last_indexed_at"] and r["last_indexed_at"].isoformat()} for r in rows]

    def file(self, repo: str, path: str, branch: str | None = None, first_line: int = 1, budget: int | None = None) -> dict:
        """One version of a file, line-paged to the budget: ``next_line`` continues it, at least one line at a time."""
        with self._slots:
            row = self._timed(get_file(self.corpus, repo, path, branch).orderBy("content_sha").limit(1).collect)
        if not row:
            return {"repo": repo, "file": path, "found": False}
        all_lines = (row[0]["content"] or "").split("\n")
        first = max(1, first_line)
        room = self.limits.budget(budget) - 512
        taken: list[str] = []
        for line in all_lines[first - 1 :]:
            room -= len(json.dumps(line)) + 2
            if room < 0 and taken:
                break
            taken.append(line)
        end = first + len(taken) - 1
        return {"repo": repo, "file": path, "found": True, "language": row[0]["lang"], "start_line": first, "end_line": end, "total_lines": len(all_lines), "content": "\n".join(taken), "next_line": end + 1 if end < len(all_lines) else None}

    def references(self, target: str | None = None, kind: str | None = "call", repo: str | None = None, branch: str | None = None, limit: int | None = None) -> dict:
        out: dict = {"target": target, "repo_known": True, "sites": [], "summary": {"unique": 0, "ambiguous": 0, "unresolved": 0}, "truncated": False, "query_too_broad": False}
        return self._bounded(out, lambda: self._references({**out, "summary": dict(out["summary"])}, target, kind, repo, branch, self.limits.clamp(limit)))

    def _references(self, out: dict, target: str | None, kind: str | None, repo: str | None, branch: str | None, n: int) -> dict:
        if repo is not None and self._timed(self.corpus.repos.where(F.col("name") == repo).isEmpty):
            return {**out, "repo_known": False}
        found = ref.resolve(self.corpus, target, kind, repo, branch).orderBy("repo_id", "path", "line", "edge_id").limit(n)
        rows = self._timed(found.collect)
        cands: dict[int, list[dict]] = {}
        for r in self._timed(ref.ranked_candidates(found, self.corpus, branch).orderBy("edge_id", "candidate_rank").collect) if rows else ():
            cands.setdefault(r["edge_id"], []).append({"repo": r["c_repo"], "file": r["c_path"], "kind": r["c_kind"], "start_line": r["c_start_line"], "end_line": r["c_end_line"], "same_repo": r["same_repo"]})
        for r in rows:
            out["summary"][r["resolution"]] += 1
            enclosing = {"name": r["enclosing_name"], "kind": r["enclosing_kind"], "start_line": r["enclosing_start_line"], "end_line": r["enclosing_end_line"]} if r["enclosing_name"] is not None else None
            out["sites"].append({"repo": r["repo"], "file": r["path"], "line": r["line"], "edge_kind": r["edge_kind"], "target": r["target_name"], "enclosing": enclosing, "resolution": r["resolution"], "candidate_count": r["candidate_count"], "candidates": cands.get(r["edge_id"], [])})
        out["truncated"] = len(rows) >= n
        return out

    def imports(self, direction: str, repo: str | None = None, target: str | None = None, **options) -> dict:
        """``imports``: what a repository imports; ``imported_by``: where a target is imported. Arguments are checked first."""
        error = None
        if direction not in ("imports", "imported_by"):
            error = "direction must be 'imports' or 'imported_by'"
        elif direction == "imports" and not repo:
            error = "imports needs a repository"
        elif direction == "imported_by" and not target:
            error = "imported_by needs a target"
        if error:
            return {"error": error, "sites": []}
        return self.references(target=target, kind="import", repo=repo, **options)

    def health(self) -> dict:
        """Whether the process answers; reads nothing."""
        return {"status": "ok"}

    def ready(self) -> bool:
        """Whether the tables can be read in the time of a statement."""
        try:
            with self._slots:
                self._timed(self.corpus.repos.limit(1).collect)
        except Exception:
            return False
        return True


__all__ = ["BadCursor", "Limits", "Service", "decode_cursor", "encode_cursor"]
