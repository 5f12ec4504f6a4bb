"""Most similar vectors for every vector: multi-index hashing over learned rotated binary codes, then a float rerank.

* **Codes.** Unit vectors are rotated and reduced to signs, without centring: tables and radius follow from the angle of the
  raw cosine, and about any other point than the origin that angle is wider. The rotation is learned (iterative
  quantization: alternate between the signs and the orthogonal Procrustes solution) on a bounded sample; each code block of
  ``dim`` bits has a rotation of its own, learned from another start.
* **Index.** A code is cut into substrings of ``width`` bits, each with a table of its own that holds every vector. Two
  vectors whose cosine is ``c`` differ in a bit with probability ``acos(c) / pi``; by the pigeonhole principle close codes
  agree, up to one bit, in some substring. Probing every bucket within one bit of a vector's own retrieves them. ``width``
  follows the number of vectors (buckets stay small), and the number of tables follows from ``width``, the least cosine
  wanted and ``recall``, the share of pairs at just that cosine to be retrieved; closer pairs are lost far less.
* **Distribution.** A table is probed inside one task, so vectors move once a table as 8-byte words of code, and probes
  not at all. Above ``group_rows`` vectors a table is spread over ``2**t`` tasks by leading bits of its substring, to
  which a vector goes ``1 + t`` times; ``t`` grows where vectors crowd. Equal vectors are one class represented once.
  Pairs beyond the Hamming radius are dropped in the task, which hands its pairs on in batches, and a pair found by several
  tables is kept by the first.
* **Hot buckets.** Vectors that are alike but not equal can crowd in one bucket, whose pairs no task could hold. A bucket of
  more than ``hot_rows`` leaves its table; its vectors, and those one bit away from it, go as floats to one task a pair of
  blocks, which compares them exactly and keeps the ``k`` best of every vector, so that nothing is capped and no pair list
  made.
* **Rerank.** Each remaining pair gets its exact cosine once, for both directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .counting import summed_cells


def usable(vector: str, dim: int):
    """True for vectors of ``dim`` numbers, none null or NaN, that are not all zero; never null."""
    v = F.col(vector)
    good = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def learn_rotations(sample: np.ndarray, blocks: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """``blocks`` rotations (dim x dim) that make signs of the rotated sample, unit vectors, quantize it well."""
    out = []
    for k in range(blocks):
        r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(sample.shape[1], sample.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(sample @ r >= 0, 1.0, -1.0).T @ sample)
            r = (u @ vt).T
        out.append(r)
    return np.stack(out)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(model, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column(1), dim)
            bits = np.concatenate([(x @ r) >= 0 for r in rotations], axis=1)
            pad = -bits.shape[1] % 64
            packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p.tobytes() for p in packed], pa.binary())], names=["id", "code"]
            )

    return run


def plan_tables(n: int, dim: int, least: float, recall: float, group_rows: int) -> tuple[int, int, int]:
    """(bits of a substring, number of tables, spreading bits) for ``n`` vectors."""
    width = max(8, min(24, math.ceil(math.log2(max(n, 2))) - 4))
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - one)))) if one < 1 else 1
    return width, tables, max(0, math.ceil(math.log2(max(n, 1) / group_rows)))


def _words(code: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(code), dtype=">u8").astype(np.uint64).reshape(len(code), -1)


def _substring(words: np.ndarray, at: int, width: int) -> np.ndarray:
    w, off = divmod(at, 64)
    x = words[:, w] << np.uint64(off)
    if off and off + width > 64:
        x |= words[:, w + 1] >> np.uint64(64 - off)
    return (x >> np.uint64(64 - width)).astype(np.int64)


def _in(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``of``, which is sorted."""
    if not len(of):
        return np.zeros(len(values), bool)
    k = np.searchsorted(of, values)
    k[k == len(of)] = 0
    return of[k] == values


def _spread(width: int, tables: int, t: int, hot: dict[int, np.ndarray]):
    """Rows of (table, group, own, id, code): own in its group, and as a visitor in the groups one leading bit away. Rows of a
    hot bucket leave its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            every, words = b, _words(b.column(1).to_pylist())
            for j in range(tables):
                b, part = every, _substring(words, j * width, width)
                if j in hot:
                    rest = np.flatnonzero(~_in(part, hot[j]))
                    b, part = every.take(pa.array(rest)), part[rest]
                top = part >> (width - t)
                for flip in range(t + 1):
                    group = top if flip == 0 else top ^ (1 << (flip - 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(top), j, np.int32)),
                            pa.array(group.astype(np.int32)),
                            pa.array(np.full(len(top), flip == 0)),
                            b.column(0),
                            b.column(1),
                        ],
                        names=["j", "g", "own", "id", "code"],
                    )

    return run


def _probe(width: int, t: int, radius: float, at_once: int = 1 << 21):
    """Pairs (a, b), a < b, of one table's group whose substrings differ by one bit at most and codes by ``radius``."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = key[0].as_py()
        rows = pa.Table.from_batches(list(batches))
        ids = rows.column("id").to_numpy()
        own = rows.column("own").to_numpy(zero_copy_only=False)
        words = _words(rows.column("code").to_pylist())
        sub = _substring(words, j * width, width)
        mine = np.flatnonzero(own)
        mine = mine[np.argsort(sub[mine], kind="stable")]
        keys = sub[mine]
        firsts, starts = np.unique(keys, return_index=True)
        stops = np.r_[starts[1:], len(keys)]
        for m in range(-1, width):
            # own rows probe their bucket and those one lower bit away; visitors arrive by the leading bit they flipped
            low = m < width - t
            who = np.flatnonzero(own if low else ~own)
            if not low:
                who = who[((sub[who] ^ (1 << m)) >> (width - t)) == key[1].as_py()]
            if not len(who):
                continue
            probe = sub[who] if m < 0 else sub[who] ^ (1 << m)
            k = np.searchsorted(firsts, probe)
            k[k == len(firsts)] = 0
            hit = firsts[k] == probe if len(firsts) else np.zeros(len(who), bool)
            who, k = who[hit], k[hit]
            n = stops[k] - starts[k]
            i = 0
            ends = np.cumsum(n)
            while i < len(who):
                base = ends[i - 1] if i else 0
                e = max(i + 1, int(np.searchsorted(ends, base + at_once, side="right")))
                c = n[i:e]
                a = np.repeat(who[i:e], c)
                b = mine[np.repeat(starts[k[i:e]], c) + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)]
                less = ids[a] < ids[b]
                a, b = a[less], b[less]
                x = words[a] ^ words[b]
                near = np.bitwise_count(x).sum(axis=1) <= radius
                a, b, x = a[near], b[near], x[near]
                for q in range(j):  # an earlier table keeps the pair
                    new = np.bitwise_count(_substring(x, q * width, width)) > 1
                    a, b, x = a[new], b[new], x[new]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])
                i = e

    return run


def _prefix_cells(width: int, tables: int, top: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            if b.num_rows:
                words = _words(b.column(1).to_pylist())
                yield np.concatenate([(_substring(words, j * width, width) >> (width - top)) + (j << top) for j in range(tables)])

    return cells


def _counted(width: int, tables: int, choose):
    """``(j, bucket, own, n)`` of the buckets that ``choose(table, substrings)`` yields as (rows, buckets, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = _words(b.column(1).to_pylist())
            for j in range(tables):
                for _, buckets, own in choose(j, _substring(words, j * width, width)):
                    at, n = np.unique(buckets, return_counts=True)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), j, np.int32)), pa.array(at.astype(np.int64)), pa.array(np.full(len(at), own)), pa.array(n.astype(np.int64))], names=["j", "bucket", "own", "n"]
                        )

    return run


_COUNTED = "j int, bucket long, own boolean, n long"


def crowds(codes: DataFrame, n: int, width: int, tables: int, t: int, group_rows: int, hot_rows: int) -> tuple[int, dict[int, np.ndarray]]:
    """(spreading bits so that groups stay near ``group_rows``, hot buckets by table).

    Prefixes of substrings are counted in one table of bounded size; only under a prefix that has more than ``hot_rows``
    are the buckets themselves counted. At most ``n / hot_rows`` buckets of a table are hot.
    """
    room = max(12, min(24, (tables - 1).bit_length() + max(0, math.ceil(math.log2(4 * max(n, 1) / hot_rows)))))
    top = min(width, room - (tables - 1).bit_length())
    counts = summed_cells(codes, _prefix_cells(width, tables, top), room)[: tables << top].reshape(tables, -1)
    while t < top and counts.reshape(tables, 1 << t, -1).sum(axis=2).max() > 2 * group_rows:
        t += 1
    crowded = {j: np.flatnonzero(counts[j] > hot_rows) for j in range(tables) if (counts[j] > hot_rows).any()}
    if not crowded:
        return t, {}

    def choose(j: int, part: np.ndarray):
        if j in crowded:
            yield None, part[_in(part >> (width - top), crowded[j])], True

    found = codes.mapInArrow(_counted(width, tables, choose), _COUNTED).groupBy("j", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows).toArrow()
    js, at = found.column("j").to_numpy(), found.column("bucket").to_numpy()
    return t, {int(j): np.sort(at[js == j]) for j in np.unique(js)}


def _near_hot(width: int, hot: dict[int, np.ndarray]):
    """(rows, hot buckets, own): the rows of hot buckets, and those one bit away from one. Of two hot buckets the rows of the
    greater visit the other."""

    def choose(j: int, part: np.ndarray):
        if j not in hot:
            return
        mine = _in(part, hot[j])
        yield np.flatnonzero(mine), part[mine], True
        for m in range(width):
            other = part ^ (1 << m)
            visit = np.flatnonzero(_in(other, hot[j]) & (~mine | (part > other)))
            yield visit, other[visit], False

    return choose


def _best(c: np.ndarray, k: int, least: float, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` greatest of each row that are ``least`` or more, equal ones by the smaller id."""
    edge = np.full(len(c), least)
    if c.shape[1] > k:
        edge = np.maximum(edge, np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k])
    r, q = np.nonzero(c >= edge[:, None])
    order = np.lexsort((ids[q], -c[r, q], r))
    r, q = r[order], q[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    return r[nth < k], q[nth < k]


def _exact(dim: int, k: int, least: float, at_once: int = 1024):
    """The best of a pair of blocks: ``(rep, to, cosine)`` of both directions, no more than ``k`` of a row and step."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        ids = rows.column("id").to_numpy()
        left = rows.column("left").to_numpy(zero_copy_only=False)
        x = unit_rows(rows.column("v").combine_chunks(), dim)
        one = key[2].as_py() == key[3].as_py()
        a = np.flatnonzero(left)
        b = a if one else np.flatnonzero(~left)
        for i in range(0, len(a), at_once):
            part = a[i : i + at_once]
            c = np.round(x[part] @ x[b].T, 9)
            c[ids[part][:, None] == ids[b][None, :]] = -2.0
            r, q = _best(c, k, least - 1e-9, ids[b])
            out = [(ids[part][r], ids[b][q], c[r, q])]
            if not one:
                q, r = _best(c.T, k, least - 1e-9, ids[part])
                out.append((ids[b][q], ids[part][r], c[r, q]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["rep", "to", "cosine"])

    return run


def _hot_neighbours(classes: DataFrame, codes: DataFrame, width: int, tables: int, hot: dict[int, np.ndarray], dim: int, k: int, least: float, block: int) -> DataFrame:
    """``(rep, to, cosine)`` among the vectors of hot buckets, and between those and the vectors one bit away."""
    choose = _near_hot(width, hot)
    sizes: dict[tuple[int, int], list[int]] = {}
    for r in codes.mapInArrow(_counted(width, tables, choose), _COUNTED).groupBy("j", "bucket", "own").agg(F.sum("n").alias("n")).collect():
        sizes.setdefault((r["j"], r["bucket"]), [1, 0])[0 if r["own"] else 1] = -(-r["n"] // block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own rows are in a block of their own and meet it, the later own blocks and all blocks of visitors; visitors meet
        the own blocks."""
        for b in batches:
            if not b.num_rows:
                continue
            words, ids = _words(b.column(1).to_pylist()), b.column(0).to_numpy()
            spot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for j in hot:
                for rows, buckets, own in choose(j, _substring(words, j * width, width)):
                    for h in np.unique(buckets):
                        mine, visiting = sizes[j, int(h)]
                        some = rows[buckets == h]
                        at = (spot[some] % np.uint64(mine if own else max(1, visiting))).astype(np.int64) + (0 if own else mine)
                        other = np.arange(mine + visiting if own else mine)
                        p, q = np.repeat(at, len(other)), np.tile(other, len(some))
                        n = len(p)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, j, np.int32)), pa.array(np.full(n, h, np.int64)), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(p <= q),
                                pa.array(np.repeat(ids[some], len(other))),
                            ],
                            names=["j", "h", "x", "y", "left", "id"],
                        )

    placed = codes.mapInArrow(place, "j int, h long, x long, y long, left boolean, id long").join(classes.select("id", "v"), "id")
    return placed.groupBy("j", "h", "x", "y").applyInArrow(_exact(dim, k, least), "rep long, to long, cosine double")


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = unit_rows(b.column(2), dim), unit_rows(b.column(3), dim)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], names=["a", "b", "cosine"])

    return run


def nearest_neighbours(
    df: DataFrame,
    key: str = "id",
    vector: str = "embedding",
    dim: int = 128,
    k: int = 5,
    least_cosine: float = 0.8,
    recall: float = 0.97,
    sample_rows: int = 20_000,
    group_rows: int = 1 << 17,
    hot_rows: int = 1 << 13,
) -> DataFrame:
    """``(key, neighbour, cosine, place)``: for every usable vector the ``k`` others with the highest cosine of at least
    ``least_cosine``; equal cosines go by the smaller key.

    Every usable vector is indexed and queries. ``recall`` is the expected share of retrieved pairs at ``least_cosine``
    itself. Vectors that are null, of another length, all zero or hold a null, NaN or infinity neither query nor answer;
    rows that repeat a key count once. Equal vectors are each other's neighbours with cosine 1. The rotation is learned on
    ``sample_rows`` rows at most, chosen by the hash of their key.
    """
    spark = df.sparkSession
    good = df.where(usable(vector, dim) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"), F.col(vector).alias("v")
    )
    # a class is one vector, known by 128 bits of hash: copies and rows repeated under one key meet here
    classes = cut_lineage(good.groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("m")).select("h1", "h2", "m.id", "m.v"))
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").toArrow()
    width, tables, t = plan_tables(n, dim, least_cosine, recall, group_rows)
    sample_x = unit_rows(sample.column(0).combine_chunks(), dim) if n else np.eye(dim)
    rotations = learn_rotations(sample_x, -(-tables * width // dim))
    model = spark.sparkContext.broadcast(rotations)
    bits = len(rotations) * dim
    p = math.acos(least_cosine) / math.pi
    radius = bits * p + 3.0 * math.sqrt(bits * p * (1 - p))
    codes = cut_lineage(classes.select("id", "v").mapInArrow(_encode(model, dim), "id long, code binary"))
    t, hot = crowds(codes, n, width, tables, t, group_rows, hot_rows)
    spread = codes.mapInArrow(_spread(width, tables, t, hot), "j int, g int, own boolean, id long, code binary")
    found = spread.groupBy("j", "g").applyInArrow(_probe(width, t, radius), "a long, b long")
    vecs = classes.select("id", "v")
    both = found.join(vecs.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vecs.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    scored = both.select("a", "b", "va", "vb").mapInArrow(_cosines(dim), "a long, b long, cosine double").where(F.col("cosine") >= least_cosine - 1e-9)
    cos = F.round("cosine", 9).alias("cosine")
    directed = scored.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("to")), F.struct(F.col("b").alias("rep"), F.col("a").alias("to")))).alias("x"), cos).select("x.rep", "x.to", "cosine")
    if hot:
        crowd = _hot_neighbours(classes, codes, width, tables, hot, dim, k, least_cosine, hot_rows)
        # hot buckets of several tables, and another table, may find the same pair
        directed = directed.unionByName(crowd).repartition("rep").groupBy("rep", "to").agg(F.max("cosine").alias("cosine"))
    # k classes are enough for every member, but a class counts with its copies: the first k ids of each are kept
    member = good.select("id", "h1", "h2").distinct().join(classes.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("id", "rep")
    in_class = W.partitionBy("rep").orderBy("id")
    heads = member.withColumn("nth", F.row_number().over(in_class)).where(F.col("nth") <= k + 1)
    reach = directed.withColumn("r", F.dense_rank().over(W.partitionBy("rep").orderBy(F.desc("cosine")))).where(F.col("r") <= k).drop("r")
    options = reach.join(heads.where(F.col("nth") <= k).select(F.col("rep").alias("to"), F.col("id").alias("neighbour")), "to").select("rep", "neighbour", "cosine")
    options = options.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k).drop("n")
    shared = heads.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    options = options.unionByName(shared)
    per = W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    out = member.join(options, "rep").where(F.col("id") != F.col("neighbour")).withColumn("place", F.row_number().over(per)).where(F.col("place") <= k)
    return out.select(F.col("id").alias(key), "neighbour", "cosine", "place")
