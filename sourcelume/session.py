"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = 8, app: str = "sourcelume", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitting job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOURCELUME_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def partitions(spark: SparkSession) -> int:
    """Tasks for a stage of Python work: what the session shuffles with, but enough for every core.

    Given to ``repartition(n, ...)``, which adaptive execution leaves as it is: its coalescing goes by bytes and
    would put CPU-heavy rows into too few tasks.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; only where that is unset, a local one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sourcelume-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later actions neither repeat it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its plan's estimated size is at most ``limit`` bytes; otherwise as it is, so that the
    join goes by shuffle (or whatever adaptive execution finds). For dimensions beside tables of contents: moving the
    contents to meet them is what must not happen while it can be avoided."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def broadcast_if_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, computed once, marked for broadcast if it has at most ``most`` (narrow) rows; otherwise as it is, for a
    shuffle. For the right side of a join with contents that came out of joins itself, whose size no plan tells."""
    rows = cut_lineage(df)
    return F.broadcast(rows) if rows.count() <= most else rows
