"""Near-duplicate texts by a blocked sparse product of the document by n-gram incidence matrix.

The rows of the matrix are distinct texts, its columns word n-grams, rarest first. Multiplying it with its transpose gives
the number of common n-grams of every pair. Two bounds derived from the sizes keep the product sparse, and lose no pair:

* a pair with Jaccard similarity t or more shares an n-gram among the rarest ``|x| - ceil(t |x|) + 1`` of either text, so
  only this part of each row is multiplied;
* sizes differ by a factor of at most ``1 / t``, and after the last common n-gram of the multiplied parts at most
  ``min(rest of x, rest of y)`` more can follow; pairs below the overlap they need are discarded.

What is left is counted exactly over the whole rows. "Rarest" needs no exact counts, only one order for all texts: it
comes from a table of hashed counts over all rows, of bounded size; a count that is too high makes a run slower, not wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, partitions
from .components import connected_components
from .counting import summed_cells

WORD = re.compile(r"[A-Za-z0-9_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str | None], n: int, least: int) -> list[np.ndarray | None]:
    """For each text the sorted distinct hashes of its runs of ``n`` successive words; None under ``least`` words."""
    words = [WORD.findall(t or "") for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for ws in words for w in ws]
    out: list[np.ndarray | None] = [None] * len(texts)
    if len(flat) < n:
        return out
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]
    with np.errstate(over="ignore"):
        grams = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            grams = _mix(grams * _MIX + h[k : len(h) - n + 1 + k])
    at = 0
    for i, size in enumerate(sizes):
        if size >= max(least, n):
            out[i] = np.unique(grams[at : at + size - n + 1])
        at += size
    return out


def pack(grams: np.ndarray) -> bytes:
    """The leading 40 bits of sorted hashes; two of one pair of texts agree by chance about once in 10**12."""
    return (grams >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _grams(n: int, least: int):
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if s is None else pack(s) for s in shingle_hashes(text.to_pylist(), n, least)], pa.binary())

    return F.arrow_udf(run, "binary")


def _cells(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(40 - bits)).astype(np.int64)


def _counts(bits: int, n: int, least: int):
    """Cells of the n-grams of ``(text, doc)``. A text counts once a task however many copies of it there are, so that the
    n-grams of a popular file do not look common; each count is still at least the number of different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[int] = set()
        for b in batches:
            texts = [None if d in seen or seen.add(d) else t for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            sets = [x for x in shingle_hashes(texts, n, least) if x is not None]
            yield _cells(np.concatenate(sets) >> np.uint64(24), bits) if sets else np.zeros(0, np.int64)

    return run


def _product_rows(table, bits: int, t: float, extra: float, block: int):
    """The multiplied part of each row, one record an n-gram; those of a hot n-gram are spread over pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for b in batches:
            out: list[tuple] = []
            for doc, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g is None:
                    continue
                grams = unpack(g)
                c = counts[_cells(grams, bits)]
                order = np.lexsort((grams, c))
                size = len(grams)
                head = order[: size - int(np.ceil(t * size - 1e-9)) + 1 + int(extra * size)]
                grams, c = grams[head], c[head]
                at = np.arange(len(head), dtype=np.int64)
                k = (c.astype(np.int64) - 1) // block + 1  # blocks of this n-gram
                # one number for size, place and side: rows sort by size
                packed = (np.int64(size) << np.int64(33)) | (at << np.int64(2))
                if (k <= 1).all():
                    out.append((grams.view(np.int64), np.full(len(grams), doc), packed))
                    continue
                mine = (_mix(np.array([doc], dtype=np.int64).astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % k
                rep = np.repeat(np.arange(len(grams)), k)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
                m = mine[rep]
                pair = np.minimum(m, other) * (1 << 31) + np.maximum(m, other)
                # n-gram and pair of blocks as one key; should two of them meet in it, the exact count still tells
                key = np.where(k[rep] > 1, _mix(grams[rep] ^ _mix((pair + 1).view(np.uint64))), grams[rep]).view(np.int64)
                out.append((key, np.full(len(rep), doc), packed[rep] | np.where(m == other, 0, np.where(m < other, 1, 2))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["key", "doc", "packed"])

    return run


def _multiply(t: float, rows_at_once: int):
    """Common n-grams of pairs within one task, from records that the task holds sorted by key and size."""

    def pairs_of(key, doc, packed):
        size, at, side = packed >> 33, (packed >> 2) & 0x7FFFFFFF, packed & 3
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        stop = np.r_[start[1:], len(key)]
        end_of = np.repeat(stop, stop - start)
        # partners follow in the same run, up to the size that the bound allows
        far = np.arange(1, len(key) + 1)
        shared = stop - start > 1
        for s, e in zip(start[shared], stop[shared]):
            far[s:e] = s + np.searchsorted(size[s:e], np.floor(size[s:e] / t + 1e-9), side="right")
        n = np.minimum(far, end_of) - np.arange(len(key)) - 1
        i = 0
        while i < len(key):
            j = i + max(1, int(np.searchsorted(np.cumsum(n[i:]), rows_at_once, side="right")))
            a = np.repeat(np.arange(i, j), n[i:j])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
            ok = ((side[a] == 0) | (side[a] != side[b])) & (doc[a] != doc[b])
            a, b = a[ok], b[ok]
            flip = doc[a] > doc[b]
            x, y = np.where(flip, b, a), np.where(flip, a, b)
            yield pd.DataFrame({"a": doc[x], "b": doc[y], "size_a": size[x], "size_b": size[y], "at_a": at[x], "at_b": at[y]})
            i = j

    def flush(found: list[pd.DataFrame]):
        d = pd.concat(found)
        return d.groupby(["a", "b", "size_a", "size_b"], sort=False).agg(n=("at_a", "size"), at_a=("at_a", "max"), at_b=("at_b", "max")).reset_index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "doc", "packed")
        rest = None
        found: list[pd.DataFrame] = []
        held = 0

        def emit():
            d = flush(found)
            found.clear()
            return pa.RecordBatch.from_pandas(d.astype({"a": "int64", "b": "int64", "size_a": "int32", "size_b": "int32", "n": "int64", "at_a": "int32", "at_b": "int32"}), preserve_index=False)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            key = cols[0]
            if not len(key):
                continue
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            rest = [c[last:] for c in cols]
            if last:
                for d in pairs_of(*(c[:last] for c in cols)):
                    if len(d):
                        found.append(d)
                        held += len(d)
                        if held >= rows_at_once:
                            yield emit()
                            held = 0
        if rest is not None and len(rest[0]):
            for d in pairs_of(*rest):
                if len(d):
                    found.append(d)
                    held += len(d)
                    if held >= rows_at_once:
                        yield emit()
                        held = 0
        if found:
            yield emit()

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(np.intersect1d(unpack(x), unpack(y), assume_unique=True)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(n, pa.int32())], names=["a", "b", "size_a", "size_b", "common"])


def similar_texts(
    docs: DataFrame, key: str, text: str, threshold: float = 0.8, n: int = 5, least_words: int = 50, max_count_bits: int = 24, extra: float = 0.0, block: int = 2048,
    every: DataFrame | None = None,
) -> DataFrame:
    """Pairs ``(a, b, common, similarity)`` of distinct texts, a < b, with Jaccard similarity of at least ``threshold``.

    ``key`` is a long that is unique in ``docs``, whose texts should be distinct and which should be partitioned by it (see
    ``distinct_texts``): its rows then do not move again. The set of a text holds its distinct runs of ``n`` successive
    words ``[A-Za-z0-9_]+``; texts of fewer than ``least_words`` words, null and empty ones take no part. The table of
    hashed counts has some 16 cells a text, ``2**max_count_bits`` at most (4 bytes each, broadcast); ``every`` (``text``,
    ``doc``) may name the rows to count instead, before copies were taken out, which spares a shuffle. Multiplying a share ``extra`` of each row
    beyond what is needed to find every pair sharpens the second bound. No pair is lost, none is capped.
    """
    spark = docs.sparkSession
    counted = docs.select(text, F.col(key).cast("long").alias("doc")) if every is None else every.select(text, F.col("doc").cast("long").alias("doc"))
    bits = min(max_count_bits, max(12, counted.count().bit_length() + 4))
    counts = np.maximum(summed_cells(counted, _counts(bits, n, least_words), bits), 1)
    table = spark.sparkContext.broadcast(counts)
    matrix = docs.select(F.col(key).alias("doc"), _grams(n, least_words)(F.col(text)).alias("grams"))
    rows = matrix.mapInArrow(_product_rows(table, bits, threshold, extra, block), "key long, doc long, packed long")
    rows = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "packed")
    found = rows.mapInArrow(_multiply(threshold, 1 << 20), "a long, b long, size_a int, size_b int, n long, at_a int, at_b int")
    found = found.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    follow = F.least(F.col("size_a") - 1 - F.col("at_a"), F.col("size_b") - 1 - F.col("at_b"))
    found = found.where(F.col("n") + follow >= need).select("a", "b", "size_a", "size_b")
    # both rows of a pair come by one join, and meet by the pair
    ends = found.select("*", F.explode(F.array("a", "b")).alias("doc"))
    few = docs.join(ends.select(F.col("doc").alias(key)).distinct(), key, "left_semi").select(F.col(key).alias("doc"), _grams(n, least_words)(F.col(text)).alias("grams"))
    ends = ends.join(few, "doc")
    both = ends.groupBy("a", "b", "size_a", "size_b").agg(F.min(F.struct("doc", "grams"))["grams"].alias("grams_a"), F.max(F.struct("doc", "grams"))["grams"].alias("grams_b"))
    exact = both.select("a", "b", "size_a", "size_b", "grams_a", "grams_b").mapInArrow(_overlap, "a long, b long, size_a int, size_b int, common int")
    similarity = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    return exact.select("a", "b", "common", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def distinct_texts(files: DataFrame, text: str = "content", sha: str = "content_sha") -> DataFrame:
    """One row ``(doc, text)`` for each text; ``doc`` is 64 bits of hash of its sha, by which the rows are partitioned.
    (Among 10**8 different texts two share a ``doc`` with a probability of 0.0003; one of them would be left out.)"""
    return files.where(F.col(text).isNotNull()).groupBy(F.xxhash64(sha).alias("doc")).agg(F.min(text).alias(text))


def _members(files: DataFrame, key: str, text: str, sha: str) -> DataFrame:
    return files.where(F.col(text).isNotNull() & F.col(sha).isNotNull()).select(F.xxhash64(sha).alias("doc"), F.col(key).alias("copy")).distinct()


def duplicate_pairs(files: DataFrame, threshold: float, key: str = "id", text: str = "content", sha: str = "content_sha", **options) -> tuple[DataFrame, DataFrame]:
    """(pairs of different texts ``a, b, common, similarity``, their members ``doc, copy``): a text is known by the hash of its
    sha, and ``copy`` is the key of every row that has it. So a text is compared, and a pair stated, once, however many
    copies there are. Rows with a null text or sha take no part; a row stored twice under one key counts once."""
    files = files.select(key, text, sha).where(F.col(sha).isNotNull())
    pairs = similar_texts(distinct_texts(files, text, sha), "doc", text, threshold, every=files.select(text, F.xxhash64(sha).alias("doc")), **options)
    return pairs, _members(files, key, text, sha)


def pairs_of_copies(pairs: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Pairs of rows ``(key_a, key_b, similarity)``, key_a < key_b: every copy of one text with every copy of the other. For
    those who need the rows themselves; ``pairs`` with ``members`` says the same in far fewer."""
    left, right = (members.select(F.col("doc").alias(d), F.col("copy").alias(c)) for d, c in (("a", "ca"), ("b", "cb")))
    out = pairs.join(left, "a").join(right, "b")
    return out.select(F.least("ca", "cb").alias(f"{key}_a"), F.greatest("ca", "cb").alias(f"{key}_b"), "similarity")


def duplicate_groups(files: DataFrame, threshold: float, key: str = "id", text: str = "content", sha: str = "content_sha", **options) -> DataFrame:
    """One row a file: ``class_id`` (smallest key of its group of copies and similar texts) and ``links``, the number of
    other distinct texts similar to its own. Rows with a null text form a class of their own."""
    rows = files.select(key, text, sha)
    pairs = cut_lineage(similar_texts(distinct_texts(rows.where(F.col(sha).isNotNull()), text, sha), "doc", text, threshold, every=rows.where(F.col(sha).isNotNull()).select(text, F.xxhash64(sha).alias("doc")), **options).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("links"))
    roots = connected_components(pairs, "a", "b").select(F.col("node").alias("doc"), "component")
    lone = F.col(text).isNull() | F.col(sha).isNull()
    out = rows.select(key, F.when(~lone, F.xxhash64(sha)).alias("doc")).distinct().join(links, "doc", "left").join(roots, "doc", "left")
    out = out.withColumn("__class", F.coalesce("component", "doc"))
    first = out.where("__class IS NOT NULL").groupBy("__class").agg(F.min(key).alias("__first"))
    out = out.join(first, "__class", "left")
    return out.select(key, F.coalesce("__first", key).cast("long").alias("class_id"), F.coalesce("links", F.lit(0)).cast("int").alias("links"))
