"""Parquet-backed relations of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The relation ``name`` under ``root``; columns and filters are pruned into the scan by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least as many partitions as cores: a small file is one split, but work in Python on its rows
    needs every core. Large inputs have splits enough and are left as they are, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a catalog table bucketed and sorted by ``key``. Files (by ``id``) and the tables that belong to them
    (symbols, edges and chunks by ``file_id``) saved with one number of buckets join without moving either side."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
