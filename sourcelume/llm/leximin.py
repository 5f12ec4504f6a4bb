"""One ranking from several differently-scaled scores, by leximin order of percentiles.

A score counts only through its percentile: the share of items it places behind an item, equal scores sharing the best
place. Each item's percentiles are sorted ascending and these arrays compared lexicographically, the greatest first. The
weakest score decides, the next one breaks ties; no score can mask another, and none rules by its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import ts_entries
from ..session import cut_lineage, partitions
from .knn import unit_rows, usable


def leximin_vector(*percentiles: Column) -> Column:
    """The array by which items are compared; a null percentile counts as the worst."""
    return F.sort_array(F.array(*(F.coalesce(p, F.lit(0.0)) for p in percentiles)))


def places(df: DataFrame, score: str, per: list[str], out: str, buckets: int = 4096) -> DataFrame:
    """``df`` with ``out``: 1 + the number of rows of the same ``per`` whose ``score`` is higher; null and NaN come last.

    Rows are first counted by value; the values of a group are ranked in two levels, score ranges within it and then
    the values of a range, so that no group, however large, is sorted in one task.
    """
    number = F.col(score).cast("double")
    d = df.withColumn("__s", F.when(number.isNull() | F.isnan(number), float("-inf")).otherwise(number) + F.lit(0.0))
    values = d.groupBy(*per, "__s").agg(F.count(F.lit(1)).alias("__n"))
    finite = F.when(F.abs(F.col("__s")) < float("inf"), F.col("__s"))
    span = values.groupBy(*per).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))

    def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        names = {c: f"__k{i}" for i, c in enumerate(keys)}
        right = right.withColumnsRenamed(names)
        return left.join(right, [left[c].eqNullSafe(right[k]) for c, k in names.items()]).drop(*names.values())

    values = meet(values, span, per)
    inner = F.floor((F.col("__s") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (buckets - 1))
    part = F.when(F.col("__s") == float("-inf"), -1).when(F.col("__s") == float("inf"), buckets).when(F.col("__hi") > F.col("__lo"), inner).otherwise(0)
    values = values.select(*per, "__s", "__n", part.cast("int").alias("__p"))
    ahead = lambda value, keys, order: F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = values.groupBy(*per, "__p").agg(F.sum("__n").alias("__m")).withColumn("__above", ahead("__m", per, "__p"))
    values = meet(values.withColumn("__inside", ahead("__n", [*per, "__p"], "__s")), ranges.drop("__m"), [*per, "__p"])
    return meet(d, values.select(*per, "__s", (F.col("__above") + F.col("__inside") + 1).alias(out)), [*per, "__s"]).drop("__s")


def percentile(place: Column, total: Column) -> Column:
    return (total - place) / F.greatest(total - 1, F.lit(1))


def leximin_rank(df: DataFrame, scores: list[str], key: str, per: list[str] | None = None) -> DataFrame:
    """``df`` with a percentile column ``pct_<score>`` for each score, ``leximin`` (the sorted array) and ``rank`` within
    ``per`` (all rows if empty); equal arrays go by the smaller ``key``, rows with equal keys too in no stated order. Columns
    of ``df`` that have one of the added names are replaced. Null and NaN scores are placed last, together."""
    group = per or ["__all"]
    kept = [c for c in df.columns if c not in ("leximin", "rank", *(f"pct_{s}" for s in scores))]
    out = df.select(*kept)
    out = out if per else out.withColumn("__all", F.lit(0))
    total = out.groupBy(*group).agg(F.count(F.lit(1)).alias("__total"))
    for s in scores:
        out = places(out, s, group, f"__place_{s}")
    names = {c: f"__t{i}" for i, c in enumerate(group)}
    total = total.withColumnsRenamed(names)
    out = out.join(total, [out[c].eqNullSafe(total[k]) for c, k in names.items()])
    out = out.select(*group, *[c for c in kept if c not in group], *[percentile(F.col(f"__place_{s}"), F.col("__total")).alias(f"pct_{s}") for s in scores])
    out = out.withColumn("leximin", leximin_vector(*[F.col(f"pct_{s}") for s in scores]))
    # sorted by ranges of (array, key), so that ties spread over tasks too; a rank is the rows of the ranges before, and
    # the place within its own
    desc = F.transform("leximin", lambda x: -x)
    out = out.withColumn("__d", desc).repartitionByRange(partitions(df.sparkSession), *group, "__d", key).sortWithinPartitions(*group, "__d", key)
    out = cut_lineage(out.drop("__d").withColumn("__m", F.monotonically_increasing_id()).withColumn("__pid", F.spark_partition_id()))
    parts = out.groupBy(*group, "__pid").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    parts = parts.withColumn("__above", F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    names = {c: f"__k{i}" for i, c in enumerate([*group, "__pid"])}
    parts = parts.drop("__n").withColumnsRenamed(names)
    out = out.join(parts, [out[c].eqNullSafe(parts[k]) for c, k in names.items()])
    return out.select(*kept, *[f"pct_{s}" for s in scores], "leximin", (F.col("__above") + F.col("__m") - F.col("__first") + 1).alias("rank"))


def block_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, starts, queries): the queries of word ``w`` are ``queries[starts[w]:starts[w + 1]]``. Words are lower
    case, separated by blanks, and count once a query."""
    pairs = sorted({(w, i) for i, t in enumerate(texts) for w in (t or "").lower().split()})
    words = sorted({w for w, _ in pairs})
    starts = np.searchsorted(np.array([w for w, _ in pairs], dtype=object), np.array([*words, chr(0x10FFFF) * 2], dtype=object)) if pairs else np.zeros(1, np.int64)
    return words, starts.astype(np.int64), np.array([i for _, i in pairs], dtype=np.int64)


def _head(found: list[tuple], k: int) -> list[tuple]:
    """Of (query, chunk, hits, cosine) the ``k`` first by cosine of every query and number of hits."""
    if not found:
        return []
    q, ids, hits, c = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -c, hits, q))
    q, ids, hits, c = q[order], ids[order], hits[order], c[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (hits[1:] != hits[:-1])][: len(q)]
    first = np.flatnonzero(new)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return [(q[keep], ids[keep], hits[keep], c[keep])]


def _first_pass(block, dim: int, k: int, at_once: int = 2048):
    """Of each task and query: the ``k`` first by cosine of the rows with each number of hits (``n`` = 0), and how many rows
    have that number (``n`` > 0; not for no hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, words, starts, queries = block.value
        known = pa.array(words, pa.string())
        best: list[tuple] = []
        counts: dict[tuple[int, int], int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                b = whole.slice(at, at_once)
                ids = b.column(0).to_numpy()
                c = np.round(unit_rows(b.column(1), dim) @ q.T, 9)
                hits = np.zeros(c.shape, np.int64)
                flat = b.column(2).flatten()
                rows = np.repeat(np.arange(len(ids)), pc.list_value_length(b.column(2)).to_numpy())
                word = pc.index_in(flat.field("word"), value_set=known).to_numpy(zero_copy_only=False)
                if len(word):
                    word = word.astype(np.int64)
                    n = starts[word + 1] - starts[word]
                    to = queries[np.repeat(starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    np.add.at(hits, (np.repeat(rows, n), to), np.repeat(flat.field("n").to_numpy(), n))
                r, col = np.nonzero(hits)
                pair, m = np.unique(np.stack([col, hits[r, col]]), axis=1, return_counts=True)
                for a, h, x in zip(*pair.tolist(), m.tolist()):
                    counts[a, h] = counts.get((a, h), 0) + x
                best.append((col, ids[r], hits[r, col], c[r, col]))
                c[r, col] = -2.0
                m = min(k, len(ids))
                low = -np.partition(-c, m - 1, axis=0)[m - 1] if len(ids) > m else np.full(len(qids), -2.0)
                r, col = np.nonzero((c >= low) & (c > -2.0))
                best.append((col, ids[r], np.zeros(len(r), np.int64), c[r, col]))
                best = _head(best, k)
        for col, ids, h, c in best:
            yield pa.RecordBatch.from_arrays([pa.array(qids[col]), pa.array(ids), pa.array(h), pa.array(c), pa.array(np.zeros(len(h), np.int64))], names=["query_id", "chunk_id", "hits", "cosine", "n"])
        if counts:
            col, h = (np.array(x, np.int64) for x in zip(*counts))
            none = np.zeros(len(h))
            yield pa.RecordBatch.from_arrays([pa.array(qids[col]), pa.array(none.astype(np.int64)), pa.array(h), pa.array(none), pa.array(np.array(list(counts.values()), np.int64))], names=["query_id", "chunk_id", "hits", "cosine", "n"])

    return run


def _count_above(block, dim: int):
    """How many rows of this task have a higher cosine than each threshold of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, cuts = block.value
        sums = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for b in batches:
            if b.num_rows:
                cos = np.round(unit_rows(b.column(0), dim) @ q.T, 9)
                for i, cut in enumerate(cuts):
                    sums[i] += np.bincount(np.searchsorted(cut, cos[:, i], side="left"), minlength=len(cut) + 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(qids, [len(c) for c in cuts])),
                pa.array(np.concatenate(cuts)),
                pa.array(np.concatenate([np.cumsum(s[::-1])[::-1][1:] for s in sums])),
            ],
            names=["query_id", "cosine", "above"],
        )

    return run


def rank_for_queries(chunks: DataFrame, queries: DataFrame, k: int = 5, dim: int = 128, block_queries: int = 2048) -> DataFrame:
    """The ``k`` first chunks of each query by leximin over two scores: cosine to the query's vector, and text hits.

    ``chunks`` has ``chunk_id, embedding, ts``; ``queries`` has ``query_id, query_text, query_embedding``. Chunks without a
    usable vector or with a null ``ts`` take no part, nor do queries without a usable vector. Columns: ``query_id,
    chunk_id, cosine, hits, place_cosine, place_hits, leximin, rank``.

    The places are those among all chunks, yet no list of pairs is made. Queries go to the chunks in blocks of
    ``block_queries``, vectors and words together, so nothing is joined by a word. Of the chunks with the same number of
    hits only the ``k`` first by cosine can be among the first ``k`` of the ranking: those are the candidates, however many
    chunks have a word. A second pass counts how many chunks have a higher cosine than each. To the driver come the
    cosines of candidates: for each query of a block ``k`` for each different number of hits.
    """
    spark = chunks.sparkSession
    sound = chunks.where(usable("embedding", dim) & F.col("ts").isNotNull()).dropDuplicates(["chunk_id"])
    asked = queries.where(usable("query_embedding", dim)).dropDuplicates(["query_id"]).select(F.col("query_id").cast("long"), "query_text", "query_embedding")
    base = cut_lineage(sound.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").alias("v"), "ts"))
    n = base.count()
    blocks = max(1, -(-asked.count() // block_queries))
    answers = []
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").toArrow()
        if not part.num_rows or not n:
            continue
        qids, q = part.column(0).to_numpy(), unit_rows(part.column(2).combine_chunks(), dim)
        words, starts, of = block_words(part.column(1).to_pylist())
        # search vectors are parsed where they are, down to the words of the block
        entries = F.filter(ts_entries(F.col("ts")), lambda e: e["word"].isin(*words)) if words else F.array().cast("array<struct<word:string,n:int>>")
        block = spark.sparkContext.broadcast((qids, q, words, starts, of))
        first = cut_lineage(base.select("chunk_id", "v", entries.alias("e")).mapInArrow(_first_pass(block, dim, k), "query_id long, chunk_id long, hits long, cosine double, n long"))
        by_hits = first.where("n > 0").groupBy("query_id", "hits").agg(F.sum("n").alias("m"))
        by_hits = by_hits.withColumn("upto", F.sum("m").over(W.partitionBy("query_id").orderBy(F.desc("hits"))))
        all_hits = by_hits.groupBy("query_id").agg((F.max("upto") + 1).alias("after"))
        alike = W.partitionBy("query_id", "hits").orderBy(F.desc("cosine"), "chunk_id")
        cand = first.where("n = 0").withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k).select("query_id", "chunk_id", "hits", "cosine")
        cand = cand.join(by_hits.select("query_id", "hits", (F.col("upto") - F.col("m") + 1).alias("place")), ["query_id", "hits"], "left").join(all_hits, "query_id", "left")
        cand = cut_lineage(cand.withColumn("place_hits", F.coalesce("place", "after", F.lit(1))).drop("place", "after"))
        cuts = cand.groupBy("query_id").agg(F.sort_array(F.collect_set("cosine")).alias("c")).orderBy("query_id").toArrow()
        at = np.searchsorted(qids, cuts.column(0).to_numpy())
        values = [np.asarray(c, dtype=np.float64) for c in cuts.column(1).to_pylist()]
        second = spark.sparkContext.broadcast((qids[at], q[at], values))
        # splits are merged so that the counts of all tasks stay small beside the vectors
        tasks = max(spark.sparkContext.defaultParallelism, n * dim * 4 // (20 * 24 * max(1, sum(map(len, values)))))
        above = base.select("v").coalesce(int(min(tasks, 1 << 20))).mapInArrow(_count_above(second, dim), "query_id long, cosine double, above long")
        answers.append(cand.join(above.groupBy("query_id", "cosine").agg((F.sum("above") + 1).alias("place_cosine")), ["query_id", "cosine"]))
    schema = "query_id long, chunk_id long, cosine double, hits long, place_cosine long, place_hits long"
    names = [c.split()[0] for c in schema.split(", ")]
    out = answers[0].select(*names) if answers else spark.createDataFrame([], schema)
    for a in answers[1:]:
        out = out.unionByName(a.select(*names))
    total = F.lit(n)
    out = out.withColumn("leximin", leximin_vector(percentile(F.col("place_cosine"), total), percentile(F.col("place_hits"), total)))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("leximin"), "chunk_id")))
    return out.where(F.col("rank") <= k)
