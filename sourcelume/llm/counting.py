"""Tables of hashed counts over all rows, summed without one task or group that grows with the number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Cells that are summed together, and parts of a segment that are summed before the whole.
SEGMENT, PARTS = 4096, 64
_SCHEMA = "segment int, part int, counts binary"


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SEGMENT, np.int64)
    for c in table.column("counts").to_pylist():
        total += np.frombuffer(c, np.int32)
    counts = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
    return pa.table({"segment": table.column("segment")[:1], "part": table.column("part")[:1], "counts": pa.array([counts], pa.binary())})


def counting_tasks(rows: DataFrame, bits: int, share: float = 0.05) -> int:
    """How many tasks may each send a table of ``2**bits`` cells without all tables together exceeding ``share`` of the
    input; enough for every core in any case."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(rows.sparkSession.sparkContext.defaultParallelism, int(min(1 << 20, share * size / (4 << bits))))


def summed_cells(rows: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Counts (32 bits, saturated) of each of ``2**bits`` cells over what ``cells`` yields for the batches of ``rows``.

    A task keeps one table and sends those of its segments that are not empty. Splits are merged (without a shuffle) so
    that the tables of all tasks stay a small part of the input, and a segment is summed in two levels.
    """
    if 1 << bits < SEGMENT:
        raise ValueError("at least one segment of cells")
    tasks = counting_tasks(rows, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << bits, np.int64)
        for found in cells(batches):
            if len(found):
                table += np.bincount(found, minlength=1 << bits)
        small = np.minimum(table, 2**31 - 1).astype(np.int32).reshape(-1, SEGMENT)
        part = TaskContext.get().partitionId() % PARTS
        for k in np.flatnonzero(small.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([small[k].tobytes()], pa.binary())], names=["segment", "part", "counts"])

    tables = rows.coalesce(tasks).mapInArrow(run, _SCHEMA)
    if tasks > PARTS:
        tables = tables.groupBy("segment", "part").applyInArrow(_add, _SCHEMA)
    summed = tables.groupBy("segment").applyInArrow(_add, _SCHEMA).toArrow()
    out = np.zeros(((1 << bits) // SEGMENT, SEGMENT), np.int32)
    for k, c in zip(summed.column("segment").to_pylist(), summed.column("counts").to_pylist()):
        out[k] = np.frombuffer(c, np.int32)
    return out.ravel()
