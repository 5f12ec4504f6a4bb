"""Repository snapshots: gzip tar archives and directory trees, filtered to indexable text."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import LANGUAGES

#: Limits of an archive, a member and the sniff for binary data.
MAX_ARCHIVE, MAX_EXTRACTED, MAX_FILE, SNIFF = 500_000_000, 2_000_000_000, 1_000_000, 8192


class BadArchive(ValueError):
    """An archive that is unsafe, truncated, too large or not of one top directory."""


@dataclass(frozen=True)
class SourceFile:
    path: str
    lang: str | None
    size: int
    content: str


def safe_name(name: str) -> str:
    """A member's path with leading ``./`` removed; absolute, empty and climbing names are an error."""
    while name.startswith("./"):
        name = name[2:]
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise BadArchive(f"unsafe member name {name!r}")
    return name


def check_link(member: str, target: str) -> None:
    """Links are never followed, but one that leads out of the tree marks the archive as bad."""
    at: list[str] = member.split("/")[:-1]
    if target.startswith("/"):
        raise BadArchive(f"link {member!r} leads outside")
    for part in target.split("/"):
        if part == "..":
            if len(at) <= 1:
                raise BadArchive(f"link {member!r} leads outside")
            at.pop()
        elif part not in ("", "."):
            at.append(part)


def language_of(path: str) -> str | None:
    m = re.search(r"\.[^./]+$", path)
    return LANGUAGES.get(m.group().lower()) if m else None


def indexable(path: str, size: int, raw: bytes) -> SourceFile | None:
    """A file to index, or None: version control data, large, binary and non-UTF-8 files are left out. NULs are dropped
    from the text; ``size`` stays that of the file."""
    if ".git" in path.split("/") or size > MAX_FILE or b"\0" in raw[:SNIFF]:
        return None
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return SourceFile(path, language_of(path), size, text.replace("\0", ""))


class _Counted(io.RawIOBase):
    """Reads a gzip stream and stops when more comes out than allowed."""

    def __init__(self, stream, most: int):
        self.stream, self.most, self.n = stream, most, 0

    def readable(self):
        return True

    def readinto(self, b):
        data = self.stream.read(len(b))
        self.n += len(data)
        if self.n > self.most:
            raise BadArchive("archive extracts to more than allowed")
        b[: len(data)] = data
        return len(data)


def scan_archive(raw: bytes, most: int | None = None) -> Iterator[SourceFile]:
    """Files of one gzip tar in archive order, its single top directory stripped. Of members with one path the first
    counts. The stream is read to its end, so that a truncated archive is an error rather than a smaller repository."""
    most = MAX_EXTRACTED if most is None else most
    if len(raw) > MAX_ARCHIVE:
        raise BadArchive("archive too large")
    tops: set[str] = set()
    seen: set[str] = set()
    members = declared = 0
    try:
        stream = io.BufferedReader(_Counted(gzip.GzipFile(fileobj=io.BytesIO(raw)), most), 1 << 16)
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for m in tar:
                if m.type in (tarfile.XHDTYPE, tarfile.XGLTYPE):
                    continue
                members += 1
                name = safe_name(m.name)
                declared += max(0, m.size)
                if declared > most:
                    raise BadArchive("archive extracts to more than allowed")
                top, _, path = name.partition("/")
                tops.add(top)
                if len(tops) > 1:
                    raise BadArchive("archive has more than one top directory")
                if m.issym() or m.islnk():
                    check_link(name, m.linkname)
                    continue
                if not m.isfile() or not path or path in seen:
                    continue
                seen.add(path)
                if m.size <= MAX_FILE:
                    found = indexable(path, m.size, tar.extractfile(m).read())
                    if found:
                        yield found
        while stream.read(1 << 16):
            pass
    except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
        raise BadArchive(f"unreadable archive: {e}") from e
    if not members:
        raise BadArchive("archive has no members")


_SCHEMA = "archive string, ord long, path string, lang string, size long, content string, error string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of the gzip tars under ``path``, in archive order by ``ord``; a bad archive gives one row with
    ``error`` and no files, so that it never stops others or passes as a smaller one; one without indexable files gives a
    row with a null path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows = [(name, i, f.path, f.lang, f.size, f.content, None) for i, f in enumerate(scan_archive(raw.as_py()))] or [(name, -1, None, None, None, None, None)]
                except BadArchive as e:
                    rows = [(name, -1, None, None, None, None, str(e))]
                for k in range(0, len(rows), 500):
                    cols = list(zip(*rows[k : k + 500]))
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["archive", "ord", "path", "lang", "size", "content", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_ARCHIVE).select("path", "content").mapInArrow(run, _SCHEMA)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(path, lang, size, content)`` of the indexable files under a directory; the filters run before contents are read
    where they can (size) and in the JVM (path, NUL sniff, UTF-8)."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_FILE)
    rel = F.expr("substring(path, instr(path, '{0}/') + {1})".format(root.replace("'", "\\'"), len(root) + 1))
    rows = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))
    rows = rows.where(~F.array_contains(F.split("path", "/"), ".git"))
    rows = rows.where(F.expr(f"position(x'00' in substring(raw, 1, {SNIFF})) = 0 AND is_valid_utf8(cast(raw as string))"))
    from ..functions.text import language

    return rows.select("path", language(F.col("path")).alias("lang"), "size", F.regexp_replace(F.col("raw").cast("string"), "\\x00", "").alias("content"))
