"""Filling containers of fixed capacity with whole documents, neighbours on a space-filling curve together.

Every document becomes a hashed word vector, projected to three dimensions; the Hilbert key of that point is a place on
one curve on which neighbours are alike. Documents are range-sorted by the key (and a hash of their id, so that copies,
which share a key, still spread over tasks) and packed along the curve: each task fills containers from windows of
successive documents that hold a few dozen containers, largest first into the fullest container that has room, and takes
what is in some poorly filled containers along to its next window. So documents share a container with their neighbours on
the curve; ``fill_report`` says how near, against a packing at random.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, partitions
from .tokens import DEFAULT, counter

_WORD = re.compile(r"\w+")
DIM, BITS, AXES = 256, 10, 3


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n x axes) with ``bits`` bits an axis (Skilling's transform)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hi = (x[:, i] & q) != 0
            x[hi, 0] ^= p
            t = (x[:, 0] ^ x[:, i]) & p
            t[hi] = 0
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, n - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    axes = np.random.default_rng(5).normal(size=(DIM, AXES))
    v = np.zeros((len(texts), DIM))
    for i, t in enumerate(texts):
        cells = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % DIM for w in _WORD.findall(t.lower())]
        v[i] = np.bincount(cells, minlength=DIM)[:DIM] if cells else 0
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    p = v @ axes
    grid = np.clip(((np.tanh(p) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(grid, BITS)


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter(path)(texts), pa.int64()), pa.array(curve_keys(texts), pa.int64())], names=["id", "tokens", "place"])

    return run


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``sizes`` in containers: largest first, each into the fullest container that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        k = bisect.bisect_left(rooms, (sizes[i], -1))
        if k == len(rooms):
            bins.append([i])
            room, j = capacity - sizes[i], len(bins) - 1
        else:
            room, j = rooms.pop(k)
            bins[j].append(i)
            room -= sizes[i]
        bisect.insort(rooms, (room, j))
    return bins


def _pack(window: int, keep: int, good: float, most: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple]] = {}
        held: dict[str, int] = {}
        capacity: dict[str, int] = {}

        def flush(name: str, last: bool) -> pa.RecordBatch:
            items, cap = waiting[name], capacity[name]
            bins = fill([x[2] for x in items], cap)
            rest = [] if last else [b for b in bins if sum(items[i][2] for i in b) < good * cap]
            # of the poorly filled ones those with the first documents of the window go out, so that nothing drifts along
            rest.sort(key=lambda b: -max(i for i in b))
            kept = {i for b in rest[:keep] for i in b}
            out: list[tuple] = []
            for b in bins:
                if b[0] not in kept:
                    first = min((items[i][0], items[i][1]) for i in b)
                    out += [(name, cap, f"{name}-{first[0]}-{first[1]}", *items[i]) for i in b]
            waiting[name] = [items[i] for i in sorted(kept)]
            held[name] = sum(x[2] for x in waiting[name])
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["name", "capacity_tokens", "container_id", "id", "piece", "tokens", "first_token", "place"])

        for b in batches:
            for name, cap, *item in zip(*(b.column(k).to_pylist() for k in range(7))):
                capacity[name] = cap
                mine = waiting.setdefault(name, [])
                mine.append(tuple(item))
                held[name] = held.get(name, 0) + item[2]
                if held[name] >= window * cap or len(mine) >= most:
                    yield flush(name, len(mine) >= most)
        for name in waiting:
            if waiting[name]:
                yield flush(name, True)

    return run


def pack_documents(
    docs: DataFrame, budgets: list[tuple[str, int]], key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT, window: int = 24, keep: int = 16, good: float = 0.98, per_task: int = 150
) -> DataFrame:
    """``(name, capacity_tokens, container_id, key, piece, first_token, tokens, place)``: where every document goes, for
    each of the named capacities; ``place`` is its key on the curve. A window holds ``window`` containers, of which up to
    ``keep`` that are filled less than ``good`` are opened again.

    Every document is in one container of each capacity, whole (``piece`` 0) unless it alone exceeds the capacity: then it
    is split into pieces of exactly the capacity, each a container of its own, and the rest, which is packed like others.
    Null texts are left out, empty ones take no room but have a place. Rows that repeat are packed as often as they come.
    There are as many tasks as have ``per_task`` containers of the largest capacity to fill, up to what the session offers
    (and beyond it only so that none has more than 16 times as many).
    """
    if any(c <= 0 for _, c in budgets):
        raise ValueError("capacities must be positive")
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), text)
    sized = cut_lineage(rows.mapInArrow(_measure(tokenizer), "id long, tokens long, place long"))
    caps = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(int(c)).cast("long").alias("cap")) for n, c in budgets])
    if not budgets:
        caps = F.array().cast("array<struct<name:string,cap:bigint>>")
    each = sized.withColumn("b", F.explode(caps)).select("id", "tokens", "place", "b.name", "b.cap")
    full = each.where("tokens > cap").select("name", "cap", "id", "place", F.explode(F.sequence(F.lit(0), (F.col("tokens") / F.col("cap")).cast("int") - 1)).alias("piece"))
    full = full.select(
        "name", F.col("cap").alias("capacity_tokens"), F.concat_ws("-", "name", "id", "piece").alias("container_id"), "id", "piece", F.col("cap").alias("tokens"), (F.col("piece") * F.col("cap")).alias("first_token"), "place"
    )
    over = F.col("tokens") > F.col("cap")
    rest = each.where(~over | (F.col("tokens") % F.col("cap") > 0)).select(
        "name", "cap", "id", F.when(over, (F.col("tokens") / F.col("cap")).cast("int")).otherwise(0).alias("piece"), F.when(over, F.col("tokens") % F.col("cap")).otherwise(F.col("tokens")).alias("tokens"),
        F.when(over, F.col("tokens") - F.col("tokens") % F.col("cap")).otherwise(F.lit(0).cast("long")).alias("first_token"), "place",
    )
    # a task leaves a container or two of each capacity half filled, so it should have some hundred to fill
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    largest = max((int(c) for _, c in budgets), default=1)
    tasks = int(max(1, min(max(partitions(spark), total // (16 * per_task * largest)), total // (per_task * largest))))
    rest = rest.repartitionByRange(tasks, "place", F.xxhash64("id")).sortWithinPartitions("place", F.xxhash64("id"))
    packed = rest.select("name", "cap", "id", "piece", "tokens", "first_token", "place").mapInArrow(
        _pack(window, keep, good), "name string, capacity_tokens long, container_id string, id long, piece int, tokens long, first_token long, place long"
    )
    out = packed.unionByName(full)
    return out.select("name", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "container_id", F.col("id").alias(key), "piece", "first_token", "tokens", "place")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, placements, tokens and the share of room used, for each capacity, and ``curve_spread``: how far apart on
    the curve the documents of a container are (root mean square), as a share of how far they would be at random."""
    place = F.col("place").cast("double")
    bins = packed.groupBy("name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.var_pop(place).alias("v"))
    shared = F.col("n") > 1
    near = F.sum(F.when(shared, F.col("v") * F.col("n"))) / F.sum(F.when(shared, F.col("n") - 1))
    total = bins.groupBy("name", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("placements"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), near.alias("near"))
    every = packed.groupBy("name").agg(F.var_pop(place).alias("all")).select(F.col("name").alias("__n"), "all")
    out = total.join(every, F.col("name") == F.col("__n"))
    out = out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    return out.withColumn("curve_spread", F.round(F.sqrt(F.col("near") / F.nullif(F.col("all"), F.lit(0.0))), 6)).drop("near", "all", "__n")
