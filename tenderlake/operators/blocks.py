"""Equi-joins of large groups without pair rows.

Two tables that share a key are dealt to blocks: each side's rows of a key go
to as many blocks as its size asks for, and every pair of blocks of a key is
one group of a cogrouped join.  Spark shuffles the rows; a group holds a
bounded number of rows of either side whatever the size of its key, so a hot
key is spread over as many tasks as it needs.  Small keys share a group: as
many as fill a pair of blocks go through one call, which compares within equal
keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.session import written

BROADCAST_BYTES = 32 * 1024 * 1024


def _row_bytes(df: DataFrame):
    """Measured bytes of a row: its strings' lengths and 16 for every other column."""
    out = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return out


def checked_broadcast(df: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its rows' measured bytes fit
    ``budget``; otherwise as it is, for a shuffle join."""
    n = int(df.agg(F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()[0])
    return F.broadcast(df) if n <= budget else df


def _by_key(key: str, fn: Callable) -> Callable:
    """``fn`` for each key that both tables of a group have."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fn(left, right)
        mine, other = (pc.unique(t.column(key)) for t in (left, right))
        if len(mine) == 1 and len(other) == 1 and mine[0] == other[0]:
            return fn(left, right)
        left, right = left.sort_by(key), right.sort_by(key)
        places = [dict(_runs(t.column(key).to_pylist())) for t in (left, right)]
        both = [k for k in places[0] if k in places[1]]
        if not both:
            return fn(left.slice(0, 0), right.slice(0, 0))
        return pa.concat_tables([fn(left.slice(*places[0][k]), right.slice(*places[1][k])) for k in both])

    return run


def _runs(keys: list) -> list[tuple[object, tuple[int, int]]]:
    out, at = [], 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            out.append((keys[at], (at, i - at)))
            at = i
    return out


def block_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, fn: Callable, schema: T.StructType | str,
               left_block: int, right_block: int) -> DataFrame:
    """``fn(left_rows, right_rows)`` (Arrow tables) for every pair of blocks
    of a key that both sides have.  Rows with a null key meet nothing.

    Both sides are read twice, for the sizes of keys and for the join: give
    tables that are cheap to read (stored ones, or ``session.written``)."""
    left, right = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
    one = F.count(F.lit(1))
    sizes = written(left.groupBy(key).agg(one.alias("_l")).join(right.groupBy(key).agg(one.alias("_r")), key), "block-sizes")
    single = (F.col("_l") <= left_block) & (F.col("_r") <= right_block)
    total = sizes.agg(F.sum(F.when(single, F.col("_l"))).alias("l"), F.sum(F.when(single, F.col("_r"))).alias("r")).first()
    groups = max(1, math.ceil((total["l"] or 0) / left_block), math.ceil((total["r"] or 0) / right_block))
    cell = F.when(single, F.pmod(F.xxhash64(key), F.lit(groups))).otherwise(F.xxhash64(key, F.lit("large")))
    sizes = checked_broadcast(sizes.select(key, cell.alias("_cell"), F.ceil(F.col("_l") / left_block).alias("_nl"), F.ceil(F.col("_r") / right_block).alias("_nr")))
    a = (left.join(sizes, key).withColumn("_lb", F.pmod(F.xxhash64(left_id), F.col("_nl")))
         .withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nr") - 1))).drop("_nl", "_nr"))
    sizes = sizes.select(*[F.col(c).alias(c) for c in sizes.columns])  # columns of its own for the other side
    b = (right.join(sizes, key).withColumn("_rb", F.pmod(F.xxhash64(right_id), F.col("_nr")))
         .withColumn("_lb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nl") - 1))).drop("_nl", "_nr"))
    return a.groupBy("_cell", "_lb", "_rb").cogroup(b.groupBy("_cell", "_lb", "_rb")).applyInArrow(_by_key(key, fn), schema)
