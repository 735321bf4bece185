"""Distributed running totals (prefix sums) without a single-task window.

``Window.orderBy(...)`` without a partition moves every row into one task;
``partitionBy(group)`` does the same for a hot group.  Here the keys and the
value alone are range-partitioned on (group, order) columns, so partitions are
balanced by sampling even when one group holds a third of the rows, and written
once with their partition's number to the shared checkpoint folder (the
assignment is then fixed for everything that reads it).  A window inside
(partition, group) gives the local prefix; the totals of earlier partitions
(one row per partition and group) are added back.  Other columns never move:
callers join the result to them on the order columns.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.session import scratch_path


def running_totals(df: DataFrame, by: list[str], order: list[str], value: str,
                   n_ranges: int | None = None, with_total: bool = False,
                   keep: list[str] | None = None) -> DataFrame:
    """Columns ``by``, ``order``, ``value`` and ``keep`` with ``before_sum`` (sum of
    ``value`` over strictly earlier rows of the same group) and ``before_count``;
    with ``with_total`` also the group's ``group_total``.  A NULL group is a group;
    a NULL value counts as 0.  Order columns must make rows unique within a
    group for the result to be deterministic."""
    spark = df.sparkSession
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(dict.fromkeys([*by, *order, value, *(keep or [])]))
    path = scratch_path(spark, f"running-{uuid.uuid4().hex}")
    (df.select(*cols).repartitionByRange(n, *by, *order).withColumn("_pid", F.spark_partition_id())
     .write.mode("overwrite").parquet(path))
    r = spark.read.parquet(path)
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    inside = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    loc = (r.withColumn("_lsum", F.coalesce(F.sum(v).over(inside), F.lit(0.0)))
           .withColumn("_lcnt", F.count(F.lit(1)).over(inside)))
    tot = r.groupBy("_pid", *by).agg(F.sum(v).alias("_ps"), F.count(F.lit(1)).alias("_pc"))
    # one row per (partition, group): bounded by partitions + groups
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*by)
    off = tot.select(F.col("_pid").alias("_opid"), *[F.col(b).alias("_o_" + b) for b in by],
                     F.coalesce(F.sum("_ps").over(w), F.lit(0.0)).alias("_os"),
                     F.coalesce(F.sum("_pc").over(w), F.lit(0)).alias("_oc"),
                     F.sum("_ps").over(wall).alias("_gt"))
    cond = [loc["_pid"] == off["_opid"]] + [loc[b].eqNullSafe(off["_o_" + b]) for b in by]
    out = loc.join(off, reduce(lambda a, b: a & b, cond))
    return out.select(*cols, (F.col("_os") + F.col("_lsum")).alias("before_sum"),
                      (F.col("_oc") + F.col("_lcnt")).cast("bigint").alias("before_count"),
                      *([F.col("_gt").alias("group_total")] if with_total else []))
