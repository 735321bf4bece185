"""Read the parquet tables of a scale-factor folder.

Reads are lazy; callers ``select`` the columns they need so that only
those reach the scan (``ReadSchema``) and filters are pushed down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, probe: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` on ``keys`` when the source scan ``probe`` gives
    fewer partitions than the cluster has cores (few large row groups), so
    that CPU-heavy per-row work that follows runs on every core.  A
    well-split input (many files / row groups, the normal case at scale) is
    returned unchanged.  Only the plain scan is probed (no job runs).
    """
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        if probe.rdd.getNumPartitions() >= cores:
            return df
    except Exception:  # noqa: BLE001  (no RDD API, e.g. a remote session)
        return df
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, cores), *keys)
