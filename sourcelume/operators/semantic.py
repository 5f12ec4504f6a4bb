"""Hybrid ranking: the nearest chunks by vector and the best by BM25, fused by reciprocal rank; for one query, or for all
queries of a table at once, in blocks against all chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import cosine, ts_entries, usable_vector
from ..plans.corpus import Corpus, default_branch, has_branch, matches
from ..plans.language import ProseQuery
from ..session import broadcast_if_few, broadcast_if_small

#: The constant of reciprocal rank fusion, rows of each leg, and BM25's usual parameters.
RRF_K, LEG, K1, B = 60, 200, 1.2, 0.75


def scoped_chunks(corpus: Corpus, filters: ProseQuery = ProseQuery(), branch: str | None = None) -> DataFrame:
    """Chunks of the files that a semantic query's filters allow, with file and repository. Filters come before ranking."""
    repos = corpus.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"), "default_branch")
    f = corpus.files.select(F.col("id").alias("file_id"), "repo_id", "path", "lang", "branches").join(broadcast_if_small(repos), "repo_id")
    named = sorted({*filters.branches, *([branch] if branch else [])})
    conditions: list[Column] = [has_branch(b) for b in named] or [has_branch(default_branch(F.col("default_branch")))]
    conditions += [matches(F.col("repo"), p, False) for p in filters.repos] + [matches(F.col("path"), p, False) for p in filters.paths]
    conditions += [F.col("lang") == x.strip().lower() for x in filters.langs]
    f = f.where(reduce(lambda a, b: a & b, conditions)).select("file_id", "repo_id", "repo", "path", "lang")
    return corpus.chunks.join(f, "file_id")


def nearest(chunks: DataFrame, vector: list[float], k: int = LEG) -> DataFrame:
    """``(id, similarity)`` of the ``k`` chunks nearest by cosine; equal ones go by id."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.where(usable_vector(F.col("embedding"), len(vector))).select("id", cosine(F.col("embedding"), q).alias("similarity"))
    return scored.orderBy(F.desc(F.round("similarity", 12)), "id").limit(k)


def postings(chunks: DataFrame) -> DataFrame:
    """``(word, chunk_id, n, len)`` of every word of every chunk with a search vector: how often it occurs, and how many
    places the chunk has. A chunk without words has one row with a null word, as it counts among the chunks."""
    e = ts_entries(F.col("ts"))
    rows = chunks.where(F.col("ts").isNotNull()).select(F.col("id").alias("chunk_id"), *[c for c in ("file_id", "repo_id") if c in chunks.columns], e.alias("e"))
    rows = rows.withColumn("len", F.aggregate("e", F.lit(0), lambda a, x: a + x["n"]))
    return rows.select(*[c for c in rows.columns if c != "e"], F.inline_outer("e")).withColumn("n", F.coalesce("n", F.lit(0)))


def bm25(chunks: DataFrame, words: list[str], k: int | None = LEG, stored: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` by Okapi BM25 over the chunks given, from their search vectors; only chunks with a hit.

    With ``stored`` postings, sorted by word, only the rows of the words asked for are read, and of the others the lengths.
    Nothing runs while the plan is made: numbers of chunks and mean length are one row, joined where they are used."""
    wanted = sorted(set(words))
    if stored is None:
        entries = chunks.where(F.col("ts").isNotNull()).select("id", ts_entries(F.col("ts")).alias("e"))
        hit = F.filter("e", lambda x: x["word"].isin(*wanted)) if wanted else F.filter("e", lambda x: F.lit(False))
        sized = entries.select("id", F.aggregate("e", F.lit(0), lambda a, x: a + x["n"]).alias("len"), hit.alias("h"))
        hits = sized.select("id", "len", F.explode("h").alias("h")).select("id", "len", "h.word", F.col("h.n").alias("tf"))
    else:
        scope = chunks.where(F.col("ts").isNotNull()).select(F.col("id").alias("chunk_id"))
        sized = stored.groupBy("chunk_id").agg(F.max("len").alias("len")).join(scope, "chunk_id", "left_semi")
        found = stored.where(F.col("word").isin(*wanted)) if wanted else stored.where(F.lit(False))
        hits = found.join(scope, "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), "len", "word", F.col("n").alias("tf"))
    # one row, and a row a word
    whole = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    df = hits.groupBy("word").agg(F.countDistinct("id").alias("df")).join(F.broadcast(whole))
    idf = df.select("word", "mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.coalesce("mean", F.lit(1.0))))
    out = hits.join(F.broadcast(idf), "word").groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def _near_block(block, k: int):
    """Of each task and query the ``k`` nearest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = block.value
        best: list[tuple] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                c = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ q.T, 12)
                m = min(k, len(c))
                edge = np.partition(c, len(c) - m, axis=0)[len(c) - m]
                r, col = np.nonzero(c >= edge)
                best.append((col, b.column(0).to_numpy()[r], c[r, col]))
            col, ids, c = (np.concatenate(z) for z in zip(*best))
            order = np.lexsort((ids, -c, col))
            col, ids, c = col[order], ids[order], c[order]
            keep = np.arange(len(col)) - np.searchsorted(col, col) < k
            best = [(col[keep], ids[keep], c[keep])]
        for col, ids, c in best:
            yield pa.RecordBatch.from_arrays([pa.array(qids[col]), pa.array(ids), pa.array(c)], names=["query_id", "id", "similarity"])

    return run


def nearest_each(chunks: DataFrame, queries: DataFrame, k: int = LEG, block: int = 1024) -> DataFrame:
    """``(query_id, id, similarity)``: the ``k`` nearest chunks of every row of ``queries`` (``query_id, vector``), equal ones by
    id. ``block`` queries at a time go to all chunks; each task hands on its own ``k`` best of a query. Queries without a
    sound vector have none."""
    spark = chunks.sparkSession
    dim = queries.select(F.max(F.size("vector"))).first()[0] or 0
    asked = queries.where(usable_vector(F.col("vector"), dim)).select(F.col("query_id").cast("long"), "vector")
    sound = chunks.where(usable_vector(F.col("embedding"), dim)).select(F.col("id").cast("long").alias("id"), "embedding")
    blocks = max(1, -(-asked.count() // block))
    out = spark.createDataFrame([], "query_id long, id long, similarity double")
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").toArrow()
        if part.num_rows:
            q = part.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            sent = spark.sparkContext.broadcast((part.column(0).to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True)))
            out = out.unionByName(sound.mapInArrow(_near_block(sent, k), "query_id long, id long, similarity double"))
    first = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).drop("__r")


def bm25_each(chunks: DataFrame, queries: DataFrame, k: int = LEG) -> DataFrame:
    """``(query_id, id, score)``: the ``k`` best chunks by BM25 of every row of ``queries`` (``query_id, words``). Search vectors
    are parsed once for all queries, and a word's rarity is counted once."""
    asked = queries.select(F.col("query_id").cast("long"), F.explode(F.array_distinct("words")).alias("word")).where("word <> ''")
    entries = chunks.where(F.col("ts").isNotNull()).select(F.col("id").cast("long").alias("id"), ts_entries(F.col("ts")).alias("e"))
    sized = entries.select("id", F.aggregate("e", F.lit(0), lambda a, x: a + x["n"]).alias("len"), "e")
    whole = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    hits = sized.select("id", "len", F.inline("e")).join(broadcast_if_small(asked.select("word").distinct()), "word", "left_semi")
    df = hits.groupBy("word").agg(F.countDistinct("id").alias("df")).join(F.broadcast(whole))
    idf = df.select("word", "mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / F.coalesce("mean", F.lit(1.0))))
    scored = hits.join(idf, "word").select("word", "id", part.alias("part")).join(broadcast_if_small(asked), "word")
    out = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).drop("__r")


def leg_rank(leg: DataFrame, metric: str, name: str, *per: str) -> DataFrame:
    """Ranks within one leg of at most ``LEG`` rows (for each ``per``): a window over small partitions."""
    return leg.withColumn(name, F.row_number().over(W.partitionBy(*per).orderBy(F.desc(F.round(metric, 12)), "id")))


def fuse(near: DataFrame, text: DataFrame, k: int | None = 10, per: tuple[str, ...] = ()) -> DataFrame:
    """``(id, rrf_score, rank_vector, rank_text)``: a full outer join of the ranked legs, for each ``per``."""
    v = leg_rank(near, "similarity", "rank_vector", *per).select(*per, "id", "rank_vector")
    t = leg_rank(text, "score", "rank_text", *per).select(*per, "id", "rank_text")
    term = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0))
    out = v.join(t, [*per, "id"], "full_outer").withColumn("rrf_score", term("rank_vector") + term("rank_text"))
    if k is None:
        return out
    if not per:
        return out.orderBy(F.desc("rrf_score"), "id").limit(k)
    first = W.partitionBy(*per).orderBy(F.desc("rrf_score"), "id")
    return out.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).drop("__r")


def hybrid_each(corpus: Corpus, queries: DataFrame, filters: ProseQuery = ProseQuery(), branch: str | None = None, k: int = 10, leg: int = LEG) -> DataFrame:
    """``hybrid`` for every row of ``queries`` (``query_id, vector, words``)."""
    chunks = scoped_chunks(corpus, filters, branch)
    fused = fuse(nearest_each(chunks, queries, leg), bm25_each(chunks, queries, leg), k, ("query_id",))
    rows = chunks.withColumn("id", F.col("id").cast("long")).join(broadcast_if_few(fused), "id").join(broadcast_if_small(queries.select(F.col("query_id").cast("long"), "vector")), "query_id")
    dim = F.size("vector")
    v = F.col("embedding")
    sound = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return rows.select("query_id", "id", "repo", "path", "chunk_index", "content", "start_line", "end_line", "rrf_score", F.when(sound, cosine(v, F.col("vector"))).alias("similarity"))


def hybrid(corpus: Corpus, vector: list[float], words: list[str], filters: ProseQuery = ProseQuery(), branch: str | None = None, k: int = 10, leg: int = LEG) -> DataFrame:
    """Ranked chunks with ``rrf_score`` and ``similarity``, which rows found by text only have as well. Contents are
    fetched for the fused rows alone."""
    chunks = scoped_chunks(corpus, filters, branch)
    fused = fuse(nearest(chunks, vector, leg), bm25(chunks, words, leg, corpus.postings), k)
    q = F.array(*[F.lit(float(x)) for x in vector])
    sound = F.when(usable_vector(F.col("embedding"), len(vector)), cosine(F.col("embedding"), q))
    return chunks.join(F.broadcast(fused), "id").select("id", "repo", "path", "chunk_index", "content", "start_line", "end_line", "rrf_score", sound.alias("similarity"))
