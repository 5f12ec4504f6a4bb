"""Snapshots as a stream: every batch of delivered file rows is indexed into the versioned store, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.run import SORTED, Rules, index_rows
from ..sources.snapshots import SnapshotStore

DELIVERED = "repo_id int, branch string, path string, lang string, size int, content string, commit string, ord long"


def apply_batch(store: SnapshotStore, batch: DataFrame, batch_id: int, whole_branches: bool = True, rules: Rules = Rules()) -> int:
    """The store's version after one batch: files, symbols, references, chunks and stamps of the delivered branches, by the
    same steps as an index run. A version notes the batch it holds, so a batch that was committed before a crash and is
    delivered again is recognized and skipped."""
    spark = batch.sparkSession
    if store.manifest()["note"].get("batch", -1) >= batch_id:
        return store.version()
    expected = store.version()
    heads = batch.groupBy("repo_id", "branch").agg(F.max_by("commit", "ord").alias("commit"), F.count("path").alias("parsed"))
    tables, buckets, *_ = index_rows(spark, store, batch, heads, rules, whole_branches)
    return store.commit(tables, expected, buckets, {"batch": batch_id}, SORTED)


def index_stream(spark: SparkSession, source: str, store: SnapshotStore, checkpoint: str, whole_branches: bool = True, rules: Rules = Rules()) -> StreamingQuery:
    """Indexes parquet files of delivered rows (``DELIVERED``) as they arrive under ``source``; ends when none is left."""
    rows = spark.readStream.schema(DELIVERED).parquet(source)
    sink: Callable[[DataFrame, int], None] = lambda df, n: apply_batch(store, df, n, whole_branches, rules)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value for each window and type; rows later than ``late`` are not waited for. Beyond the reference."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
