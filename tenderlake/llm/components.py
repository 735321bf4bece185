"""Connected components of a link table, by star contraction.

Every round makes two passes over the links: each node's neighbours above it
are linked to the least node of its neighbourhood, then each node's
neighbours below it are.  Both passes are one grouped minimum and one join;
the table shrinks to stars around the least node of each component in a
number of rounds that grows with the logarithm of the longest chain.  Every
round is written to the shared checkpoint folder, the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import drop_written, written

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """e: (a, b) with a > b."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    up = e.select(F.col("b").alias("n"), F.col("a").alias("v"))  # the neighbours above n
    return up.join(low, "n").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b), any order and repeats allowed.  Returns (node,
    component) for every linked node; the component is its least node."""
    e = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        new = written(_small_star(_large_star(e)), "cc")
        new_state = _state(new)
        drop_written(e)
        e = new
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
