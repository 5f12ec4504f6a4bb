"""Generated, minified and vendored source files, and data saved as code.

* **Vendored.** Merkle hashes are taken bottom-up: blocks of a text (a sketch of its lines), the file, every directory
  above it. A node that unrelated repositories share marks foreign code; repositories that share half of their files are
  one family, so forks are no evidence. Which side is the copy then follows from where the node lies:

  - a whole directory shared between families is the original where it lies least deep, and a copy everywhere else (a
    copy everywhere if no family alone has it least deep, as then it comes from outside);
  - a file that shares its blocks with an unrelated repository is the copy if it lies in a place for foreign code, under
    the base name of that repository, or if its head names that repository.

  Names and heads tell only the direction: without shared nodes they mark nothing. The one exception is a head that names
  a repository of which there is no file of this name here to compare with; nothing contradicts it.
* **Generated.** A comment or annotation before the first declaration says so, or the path does (lock files included).
* **Minified** and **data**: by the layout of the text: hardly any white space in long lines; nearly all of it literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small, cut_lineage
from .components import connected_components

#: Directories that hold other projects' code.
PLACES = ("vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external", "externals", "deps", "_vendor", "Godeps", "Pods")
#: Paths that only tools write.
GENERATED_PATH = re.compile(
    r"(?:^|/)(?:generated|__generated__|_generated|generated-sources|generated-src|autogen|gen)/|_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw)?\.\w+$|\.(?:g|gen|generated|designer)\.\w+$|_generated\.\w+$"
    r"|\.lock$|[-.]lock\.(?:toml|json|ya?ml)$|(?:^|/)(?:go\.sum|npm-shrinkwrap\.json)$"
)
MINIFIED_PATH = re.compile(r"\.(?:min|bundle)\.(?:js|css|mjs)$|\.chunk\.js$")
_COMMENT = re.compile(r"\s*(?://|#|/\*|\*|<!--|--|;|%|\"\"\"|''')")
SAYS_GENERATED = re.compile(
    r"@generated\b|<auto-?generated\b|^\W*auto-?generated\b|\bcode generated by\b"
    r"|^\W*(?:this (?:file|code|module|class|source) (?:is|was|has been) |file )?(?:auto(?:matically)?[- ]?)?generated (?:from|by|with|on|using|at)\b"
    r"|^\W*machine[- ](?:made|generated|written)\b|\b(?:edits|changes|modifications) (?:are|will be|may be|get) (?:overwritten|lost|discarded)\b"
    r"|^\W*(?:written|created|produced|kept) by \W*[\w.-]+ lock\b|\bdo not (?:edit|change|modify)(?: it| this| this file| by hand| manually)*\W*$|\bedit the template\b",
    re.I | re.M,
)
SAYS_ORIGIN = re.compile(r"^\W*(?:imported|vendored|copied|taken|borrowed|derived|adapted|ported)\b[^\n]*?\bfrom\b[^\n]*?\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]*[A-Za-z0-9_-])", re.I | re.M)
_LITERAL = re.compile(r"\b(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)\b,?|[\"'`](?:[A-Za-z0-9+/=]{24,}|(?:\\x[0-9a-fA-F]{2})+)[\"'`]")
_SCRIPT_PATH = re.compile(r"\.[cm]?[jt]sx?$")
_CODE_PATH = re.compile(r"\.(?:py|[cm]?[jt]sx?|go|java|rs|c|h|cc|cpp|hpp|cs|rb|php|kt|swift|scala)$")


_OPENING = re.compile(r"(?:package|import|from|use|using|export|\"use strict\"|'use strict'|#!)\b|[\"']use strict[\"']|extern crate\b|@Generated\b|@javax\.annotation\.|[)\]}]|\"[\w./-]+\"$")
#: Blocks of a text's sketch, and the rows of the sketch of a repository.
BLOCKS, SKETCH, BAND = 32, 16, 4


def head(text: str) -> str:
    """The comments, docstrings and annotations before the first declaration: package, import and similar lines are passed
    over, a block comment counts whole."""
    out, block, listing = [], "", False
    for line in text.split("\n"):
        s = line.strip()
        if block:
            out.append(s)
            if block in s:
                block = ""
            continue
        if not s:
            continue
        if not _COMMENT.match(s):
            if listing or _OPENING.match(s):
                listing = (listing or s.endswith(("(", "{"))) and not s.startswith((")", "}")) and not s.endswith((")", ");", "};"))
                if s.startswith("@"):
                    out.append(s)
                continue
            break
        out.append(s)
        if s.startswith("/*") and "*/" not in s[2:]:
            block = "*/"
        for q in ('"""', "'''"):
            if s.startswith(q) and q not in s[3:]:
                block = q
    return "\n".join(out)


def by_text(path: str, lang: str | None, text: str, blob_share: float = 0.6, blob_chars: int = 400) -> tuple[str | None, str | None]:
    """(``generated``, ``minified``, ``data`` or None; the project the head names as origin or None)."""
    if GENERATED_PATH.search(path):
        return "generated", None
    if MINIFIED_PATH.search(path):
        return "minified", None
    if not text:
        return None, None
    top = head(text)
    if SAYS_GENERATED.search(top):
        return "generated", None
    origin = SAYS_ORIGIN.search(top)
    if lang is not None or _CODE_PATH.search(path):
        blanks = text.count(" ") + text.count("\n") + text.count("\t") + text.count("\r")
        if _SCRIPT_PATH.search(path) and len(text) >= 200 and blanks < 0.06 * len(text) and len(text) > 150 * (text.count("\n") + 1) and sum(map(len, _LITERAL.findall(text))) < blob_share * len(text):
            return "minified", None
        if len(text) >= blob_chars and sum(map(len, _LITERAL.findall(text))) >= blob_share * len(text):
            return "data", None
    return None, origin.group(1) if origin else None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_hashes(texts: list[str | None], names: list[str | None]) -> list[np.ndarray]:
    """For each text up to ``BLOCKS`` hashes: its lines of four or more characters are spread over blocks by their hash,
    and a block is known by the smallest hash in it and the file's name. Texts of which a share of the lines is equal have
    about that share of blocks in common, wherever the edits are."""
    lines = [[x for x in (y.strip() for y in (t or "").split("\n")) if len(x) > 3] for t in texts]
    flat = [x for ls in lines for x in ls]
    if not flat:
        return [np.zeros(0, np.int64) for _ in texts]
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]
    salt = pd.util.hash_array(np.array([n or "" for n in names], dtype=object), categorize=False)
    row = np.repeat(np.arange(len(texts)), [len(ls) for ls in lines])
    cell = row * BLOCKS + (h % np.uint64(BLOCKS)).astype(np.int64)
    order = np.lexsort((h, cell))
    first = order[np.r_[True, cell[order][1:] != cell[order][:-1]]]
    with np.errstate(over="ignore"):
        found = _mix(h[first] ^ _mix(salt[row[first]] + np.uint64(1))).view(np.int64)
    return np.split(found, np.searchsorted(row[first], np.arange(1, len(texts))))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, langs, texts = (b.column(i).to_pylist() for i in (2, 3, 4))
        found = [by_text(p or "", x, t or "") for p, x, t in zip(paths, langs, texts)]
        blocks = block_hashes(texts, [(p or "").rsplit("/", 1)[-1] for p in paths])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), b.column(5), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array(blocks, pa.list_(pa.int64()))],
            names=["id", "repo_id", "path", "sha", "reason", "origin", "blocks"],
        )


def subtree_hashes(files: DataFrame) -> DataFrame:
    """``(repo_id, path, files, hash)`` of every directory below the root. A directory's hash is that of the set of
    (relative path, content) below it, whatever it is called itself.

    Each file is sent to all directories above it once and the hashes of what lies below are added up, which partial
    aggregation does before anything moves: no directory is listed, and the plan does not depend on the depth of paths. All
    versions of a file count.
    """
    leaf = files.where(F.col("path").isNotNull()).select("repo_id", "path", "sha").distinct().withColumn("parts", F.split("path", "/"))
    up = leaf.where(F.size("parts") > 1).select("repo_id", "sha", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    below = F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/")
    up = up.select("repo_id", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("path"), F.xxhash64(below, "sha").alias("x"), F.xxhash64(F.lit(1), "sha", below).alias("y"))
    # sums of parts of the hashes, so that nothing overflows
    sums = [F.sum(F.col(c).bitwiseAND(0xFFFFFFFF)).alias(f"{c}0") for c in "xy"] + [F.sum(F.shiftright(c, 32)).alias(f"{c}1") for c in "xy"]
    nodes = up.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("files"), *sums)
    return nodes.select("repo_id", "path", "files", F.xxhash64("files", "x0", "x1", "y0", "y1").alias("hash"))


def families(files: DataFrame, least: float = 0.5) -> DataFrame:
    """``(repo_id, family)`` of repositories that are not alone in theirs: those connected by sharing ``least`` or more of
    their (path, content) pairs, as sketches of ``SKETCH`` smallest hashes estimate; ``family`` is the smallest of them."""
    h = F.xxhash64("path", "sha")
    rows = files.where(F.col("path").isNotNull()).select("repo_id", F.pmod(h, F.lit(SKETCH)).alias("bin"), h.alias("h"))
    mins = rows.groupBy("repo_id", "bin").agg(F.min("h").alias("h"))
    bands = mins.groupBy("repo_id", F.floor(F.col("bin") / BAND).alias("band")).agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("bin", "h")))).alias("key"), F.count(F.lit(1)).alias("n"))
    bands = bands.where(F.col("n") == BAND)
    first = bands.groupBy("band", "key").agg(F.min("repo_id").alias("b"))
    pairs = bands.join(first, ["band", "key"]).where(F.col("repo_id") > F.col("b")).select(F.col("repo_id").alias("a"), "b").distinct()
    # both sketches side by side; a repository has at most one partner a band
    left = pairs.join(mins.withColumnRenamed("repo_id", "a"), "a")
    right = mins.select(F.col("repo_id").alias("b"), "bin", F.col("h").alias("g"))
    alike = left.join(right, ["b", "bin"]).groupBy("a", "b").agg(F.avg((F.col("h") == F.col("g")).cast("double")).alias("share")).where(F.col("share") >= least)
    edges = cut_lineage(alike.select("a", "b"))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("repo_id"), F.col("b").alias("family"))
    return connected_components(edges, "a", "b").select(F.col("node").alias("repo_id"), F.col("component").alias("family"))


def _base(part: Column) -> Column:
    """A directory's name without a version at its end."""
    return F.regexp_replace(part, r"[-@]v?[0-9]+(\.[0-9]+)*$", "")


def shared_directories(rows: DataFrame, least_files: int = 2) -> DataFrame:
    """``(repo_id, path)`` of directories of ``least_files`` or more files that are copies of what an unrelated repository has.
    ``rows`` has ``repo_id, family, path, sha``."""
    family = rows.select("repo_id", "family").distinct()
    nodes = subtree_hashes(rows.where(F.col("sha").isNotNull())).where(F.col("files") >= least_files).join(broadcast_if_small(family), "repo_id")
    depth = F.size(F.split("path", "/"))
    foreign = F.exists(F.split("path", "/"), lambda p: p.isin(*PLACES))
    held = nodes.select("*", depth.alias("depth"), foreign.alias("foreign"))
    # of the holders outside of places for foreign code, the family that has it least deep, if it is alone there
    own = F.when(~F.col("foreign"), F.struct("depth", "family"))
    last = F.when(~F.col("foreign"), F.struct(F.col("depth"), (-F.col("family")).alias("f")))
    holders = held.groupBy("hash").agg(F.min("family").alias("low"), F.max("family").alias("high"), F.min(own).alias("p"), F.min(last).alias("q"), F.max("foreign").alias("placed"))
    holders = holders.where("low <> high").select("hash", F.when(F.col("p.family") == -F.col("q.f"), F.col("p.family")).alias("origin"), "placed")
    copies = held.join(holders, "hash")
    # where some lie in places for foreign code these are the copies, otherwise all but the original
    return copies.where(F.col("foreign") | (~F.col("placed") & ~F.col("origin").eqNullSafe(F.col("family")))).select("repo_id", "path").distinct()


def vendored(described: DataFrame, repos: DataFrame, least_share: float = 0.15, least_blocks: int = 4) -> DataFrame:
    """``(id)`` of files that are copies of an unrelated repository's. ``described`` has ``id, repo_id, path, sha, origin,
    blocks``; a file is a copy of another if they share ``least_share`` of its blocks, and ``least_blocks`` or all it has."""
    sound = described.where(F.col("path").isNotNull() & F.col("repo_id").isNotNull() & (F.size("blocks") > 0))
    related = families(sound)
    rows = sound.join(broadcast_if_small(related), "repo_id", "left").withColumn("family", F.coalesce("family", "repo_id"))
    parts = F.split("path", "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    size = F.size("blocks")
    enough = F.greatest(F.ceil(least_share * size), F.least(size, F.lit(least_blocks)))

    # nodes of a file: its blocks, and the whole of it, which alone is enough whatever the file is called
    def nodes(df: DataFrame, *keep: str) -> DataFrame:
        each = F.transform("blocks", lambda h: F.struct(h.alias("h"), F.lit(1).alias("w")))
        whole = F.array(F.struct(F.xxhash64(F.lit("whole"), "sha").alias("h"), F.lit(BLOCKS).alias("w")))
        return df.select(*keep, F.inline(F.concat(each, whole)))

    # under the base name of another repository, or from one by its own words: shared with that repository?
    named = repos.where(F.col("name").isNotNull()).select(F.col("id").alias("repo_id"), F.explode(F.array_distinct(F.array("name", F.substring_index("name", "/", -1)))).alias("label"))
    labels = F.array_distinct(F.filter(F.concat(F.transform(above, _base), F.array("origin")), lambda x: x.isNotNull()))
    asked = rows.select("id", "family", "blocks", "sha", enough.alias("need"), F.explode(labels).alias("label"))
    asked = asked.join(broadcast_if_small(named.select("label").distinct()), "label", "left_semi")
    used = asked.select("label").distinct()
    libs = rows.join(broadcast_if_small(named.join(used, "label", "left_semi")), "repo_id").select("label", "family", "blocks", "sha")
    libs = nodes(libs, "label", "family").groupBy("label", "h").agg(F.min("family").alias("low"), F.max("family").alias("high"))
    other = (F.col("low") != F.col("family")) | (F.col("high") != F.col("family"))
    by_name = nodes(asked, "id", "family", "need", "label").join(libs, ["label", "h"]).where(other).groupBy("id", "label").agg(F.sum("w").alias("n"), F.max("need").alias("need"))
    by_name = by_name.where("n >= need").select("id")

    # in a place for foreign code: shared with any unrelated repository?
    placed = rows.where(F.exists(above, lambda p: p.isin(*PLACES))).select("id", "family", "blocks", "sha", enough.alias("need"))
    everywhere = nodes(rows.select("family", "blocks", "sha"), "family").groupBy("h").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low <> high").select("h")
    by_place = nodes(placed, "id", "need").join(everywhere, "h", "left_semi").groupBy("id").agg(F.sum("w").alias("n"), F.max("need").alias("need")).where("n >= need").select("id")

    # below a directory that is a copy as a whole
    dirs = shared_directories(rows.select("repo_id", "family", "path", "sha"))
    below = rows.where(F.size(parts) > 1).select("id", "repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    by_tree = below.join(dirs, ["repo_id", "path"], "left_semi").select("id")
    return by_name.unionByName(by_place).unionByName(by_tree)


def origin_elsewhere(described: DataFrame, repos: DataFrame) -> DataFrame:
    """``(id)`` of files whose head names another repository that has no file of this name here."""
    own = repos.select(F.col("id").alias("repo_id"), F.col("name").alias("own"))
    said = described.where(F.col("origin").isNotNull()).join(broadcast_if_small(own), "repo_id", "left").where(~F.col("origin").eqNullSafe(F.col("own")))
    base = F.substring_index("path", "/", -1)
    said = said.select("id", "origin", base.alias("base"))
    source = repos.select(F.col("id").alias("repo_id"), F.col("name").alias("origin")).join(said.select("origin").distinct(), "origin", "left_semi")
    has = described.where(F.size("blocks") > 0).select("repo_id", "path").join(broadcast_if_small(source), "repo_id").select("origin", base.alias("base")).distinct()
    return said.join(has, ["origin", "base"], "left_anti").select("id")


def files_to_set_aside(files: DataFrame, repos: DataFrame) -> DataFrame:
    """``(id, reasons)`` of every file that was not written by hand in its repository; ``reasons`` is a sorted array of
    ``generated``, ``minified``, ``data`` and ``vendored``.

    Null paths, languages and contents are judged by what is left of the row; empty and blank contents share nothing with
    anybody. Rows that repeat give one result. A repository that is missing from ``repos`` has no name to lie under.
    """
    rows = files.select("id", "repo_id", "path", "lang", "content", "content_sha")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    described = rows.mapInArrow(_describe, f"id {kinds['id']}, repo_id {kinds['repo_id']}, path string, sha string, reason string, origin string, blocks array<bigint>")
    described = cut_lineage(described)
    copies = vendored(described, repos).unionByName(origin_elsewhere(described, repos)).withColumn("reason", F.lit("vendored"))
    both = described.where("reason IS NOT NULL").select("id", "reason").unionByName(copies)
    return both.groupBy("id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
