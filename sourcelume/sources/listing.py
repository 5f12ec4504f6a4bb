"""What to index: configuration, repository and branch listing, and the choices among them.

Network access stays outside: listing and download are callables that are handed in.
"""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import glob_pattern

#: Most repositories of a run, most branches of a repository.
MAX_REPOS, MAX_BRANCHES = 500, 20


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class RepoEntry:
    name: str
    branches: tuple[str, ...] = ()


@dataclass(frozen=True)
class IndexConfig:
    orgs: tuple[str, ...] = ()
    users: tuple[str, ...] = ()
    repos: tuple[RepoEntry, ...] = ()
    exclude: tuple[str, ...] = ()
    skip_forks: bool = False
    skip_archived: bool = False
    branches: tuple[str, ...] = ()


def parse_config(raw: bytes, source: str = "config") -> IndexConfig:
    """A YAML configuration; anything malformed is a ``ConfigError`` that names the source."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise ConfigError("reading YAML needs the yaml package") from e
    try:
        data = yaml.safe_load(raw.decode("utf-8"))
    except (UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigError(f"{source}: not valid YAML") from e
    if data is None:
        data = {}
    if not isinstance(data, dict):
        raise ConfigError(f"{source}: a mapping is expected")

    def texts(key: str) -> tuple[str, ...]:
        v = data.pop(key, None) or []
        if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
            raise ConfigError(f"{source}: {key} must be a list of strings")
        return tuple(v)

    orgs, users, exclude, branches = (texts(k) for k in ("orgs", "users", "exclude", "branches"))
    repos = []
    listed = data.pop("repos", None) or []
    if not isinstance(listed, list):
        raise ConfigError(f"{source}: repos must be a list")
    for x in listed:
        entry = {"name": x} if isinstance(x, str) else x
        if not isinstance(entry, dict) or not isinstance(entry.get("name"), str) or set(entry) - {"name", "branches"}:
            raise ConfigError(f"{source}: a repository has a name and branches")
        own = entry.get("branches") or []
        if not isinstance(own, list) or not all(isinstance(b, str) for b in own):
            raise ConfigError(f"{source}: branches of a repository must be a list of strings")
        repos.append(RepoEntry(repo_slug(entry["name"]), tuple(own)))
    flags = {}
    for k in ("skip_forks", "skip_archived"):
        v = data.pop(k, None)
        if v is not None and not isinstance(v, bool):
            raise ConfigError(f"{source}: {k} must be true or false")
        flags[k] = bool(v)
    if data:
        raise ConfigError(f"{source}: unknown keys {', '.join(sorted(map(str, data)))}")
    return IndexConfig(orgs, users, tuple(repos), exclude, branches=branches, **flags)


def read_config(read: Callable[[], bytes | None], source: str = "config") -> tuple[str, IndexConfig | None, str | None]:
    """(status, configuration, message): ``ok``, ``missing`` where there is nothing to read, ``invalid`` or ``unreadable``. A
    run acts on ``ok`` alone, so that a broken configuration never looks like an empty one."""
    try:
        raw = read()
    except FileNotFoundError:
        raw = None
    except OSError as e:
        return "unreadable", None, str(e)
    if raw is None:
        return "missing", None, f"{source}: not there"
    try:
        return "ok", parse_config(raw, source), None
    except ConfigError as e:
        return "invalid", None, str(e)


LISTED = "name string, ord long, fork boolean, archived boolean, branches array<string>"


def list_wanted(spark: SparkSession, config: IndexConfig, fetch: Callable[[str], tuple[list[dict], str | None]], urls: Callable[[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """(repositories to index, dropped by reason): the union of the listings of all organizations and users of ``config``
    and of the repositories it names, in this order, by its rules. A named one is kept whatever the rules for listed ones
    say of forks and archived ones, and brings its branch patterns.

    ``urls(kind, name)`` is the first page of a listing (``org`` or ``user``), ``fetch`` gets a page: its items (``full_name``,
    ``fork``, ``archived``) and the next page's url. A page that fails fails the run.
    """
    rows: list[tuple] = []
    for kind, names in (("org", config.orgs), ("user", config.users)):
        for name in names:
            rows += [(x["full_name"], bool(x.get("fork")), bool(x.get("archived")), list(config.branches)) for x in collect_pages(fetch, urls(kind, name))]
    rows += [(r.name, False, False, [*config.branches, *r.branches]) for r in config.repos]
    named = {r.name.lower() for r in config.repos}
    rows = [(n, i, f and n.lower() not in named, a and n.lower() not in named, sorted(set(b))) for i, (n, f, a, b) in enumerate(rows)]
    kept, dropped = choose_repos(spark.createDataFrame(rows, LISTED), config.exclude, config.skip_forks, config.skip_archived)
    return check_ceiling(kept), dropped


def list_branches(spark: SparkSession, repos: DataFrame, fetch: Callable[[str], tuple[list[dict], str | None]], url: Callable[[str], str], head: Callable[[str, str | None], tuple[str, str]], most: int = MAX_BRANCHES) -> DataFrame:
    """``(repo, default_branch, branch, commit, complete)`` of the branches to index of each repository of ``repos`` (``name,
    branches``; bounded by the ceiling on repositories): the default one and those that match its patterns, ``most`` at most."""
    out = []
    for r in repos.select("name", "branches").collect():
        default, commit = head(r["name"], None)
        listed = collect_pages(fetch, url(r["name"])) if r["branches"] else []
        commits = {x["name"]: x["commit"] for x in listed} | {default: commit}
        wanted = [default, *sorted(b for b in commits if b != default and any(matches_glob(b, p) for p in r["branches"]))]
        out += [(r["name"], default, b, commits[b], len(wanted) <= most) for b in wanted[:most]]
    return spark.createDataFrame(out, "repo string, default_branch string, branch string, commit string, complete boolean")


def repo_slug(text: str) -> str:
    """``owner/name`` from a slug or a clone URL."""
    m = re.fullmatch(r"(?:(?:https?|ssh|git)://(?:[^/@]*@)?[^/]+/|[\w.-]+@[^:/]+:)?([\w.-]+/[\w.-]+?)(?:\.git)?/?", text.strip())
    if not m:
        raise ConfigError(f"not a repository: {text!r}")
    return m.group(1)


def collect_pages(fetch: Callable[[str], tuple[list[dict], str | None]], first: str) -> list[dict]:
    """All items of a paged listing; a page that fails raises, so a listing is complete or no listing."""
    out, url, seen = [], first, set()
    while url:
        if url in seen:
            raise ConfigError("paged listing repeats itself")
        seen.add(url)
        items, url = fetch(url)
        out += items
    return out


def rate_limited(status: int, headers: dict[str, str]) -> bool:
    low = {k.lower(): v for k, v in headers.items()}
    return status == 429 or status == 403 and ("retry-after" in low or low.get("x-ratelimit-remaining") == "0")


class RateLimited(RuntimeError):
    """The service asks to wait; ``retry_after`` says how many seconds, where it said so."""

    def __init__(self, retry_after: int | None):
        super().__init__("rate limited")
        self.retry_after = retry_after


def page_fetcher(request: Callable[[str], tuple[int, dict[str, str], object]]) -> Callable[[str], tuple[list[dict], str | None]]:
    """A function that fetches a page for ``collect_pages``. ``request`` answers a url with status, headers and parsed body; the
    next page is the one that the Link header names. A page that is refused raises, so a listing is complete or none."""

    def fetch(url: str) -> tuple[list[dict], str | None]:
        status, headers, body = request(url)
        low = {k.lower(): v for k, v in headers.items()}
        if rate_limited(status, headers):
            wait = low.get("retry-after", "")
            raise RateLimited(int(wait) if wait.isdigit() else None)
        if status != 200 or not isinstance(body, list):
            raise ConfigError(f"listing answered with status {status}")
        more = re.search(r'<([^<>]*)>\s*;[^,]*\brel="?next"?', low.get("link", ""))
        return body, more.group(1) if more else None

    return fetch


def choose_repos(listed: DataFrame, exclude: Iterable[str] = (), skip_forks: bool = False, skip_archived: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped by reason) of ``listed`` (name, ord, fork, archived, branches): first of names that differ in case
    only, with the branch patterns of all of them; ``reason`` counts what the rules dropped."""
    rule: Column = F.lit(None).cast("string")
    if skip_archived:
        rule = F.when(F.coalesce("archived", F.lit(False)), "archived").otherwise(rule)
    if skip_forks:
        rule = F.when(F.coalesce("fork", F.lit(False)), "fork").otherwise(rule)
    for g in exclude:
        rule = F.when(F.col("name").rlike(glob_pattern(g)), "exclude:" + g).otherwise(rule)
    rows = listed.withColumn("reason", rule)
    kept = rows.where("reason IS NULL").groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("branches")))).alias("branches")
    )
    return kept.drop("key"), rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def check_ceiling(repos: DataFrame, most: int = MAX_REPOS) -> DataFrame:
    n = repos.limit(most + 1).count()
    if n > most:
        raise ConfigError(f"more than {most} repositories")
    return repos


def choose_branches(branches: DataFrame, patterns: Iterable[str], most: int = MAX_BRANCHES) -> DataFrame:
    """``(repo_id, branch, complete)`` of ``branches`` (repo_id, branch, default_branch): the default branch first, then
    those that match a pattern in order, ``most`` at most; ``complete`` is false where more matched."""
    default = F.coalesce("default_branch", F.lit("HEAD"))
    wanted = F.col("branch") == default
    for p in patterns:
        wanted = wanted | F.col("branch").rlike(glob_pattern(p))
    rows = branches.where(wanted).withColumn("first", F.col("branch") == default)
    counts = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("first"), "branch"))).where(F.col("r") <= most)
    return ranked.join(counts, "repo_id").select("repo_id", "branch", (F.col("n") <= most).alias("complete"))


def matches_glob(name: str, pattern: str) -> bool:
    return fnmatch.fnmatchcase(name, pattern)


class Unavailable(RuntimeError):
    """Something the run needs is not there: room on disk, or an archive within its limits."""


def check_headroom(path: str, least: int = 500_000_000) -> None:
    """An error if the disk under ``path`` has fewer than ``least`` bytes free."""
    if shutil.disk_usage(path).free < least:
        raise Unavailable(f"less than {least} bytes free under {path}")


def download(open_stream: Callable[[str], Iterable[bytes]], url: str, target: str, most: int = 500_000_000) -> int:
    """Writes an archive named by an immutable commit to ``target``, part by part; the bytes written. A longer one than
    ``most`` is an error and leaves no file."""
    n = 0
    part = target + ".part"
    try:
        with open(part, "wb") as f:
            for data in open_stream(url):
                n += len(data)
                if n > most:
                    raise Unavailable(f"archive of more than {most} bytes")
                f.write(data)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return n


def resolve_heads(repos: Iterable[str], head: Callable[[str, str | None], tuple[str, str]], branches: Callable[[str], list[str]]) -> Iterator[tuple[str, str, str, str]]:
    """``(repo, default branch, branch, commit)`` of every branch listed, by callables that ask for a repository's default
    head, a branch's head, and its branches."""
    for repo in repos:
        default, _ = head(repo, None)
        for b in branches(repo):
            yield repo, default, b, head(repo, b)[1]
