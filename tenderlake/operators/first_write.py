"""First write wins at scale (S6): Bloom filters of stored ids in a manifest.

A table of documents grows by appends.  Every append has its own folder and,
in the manifest, Bloom filters of its ids: ids are dealt to shards by hash, one
filter a shard, of a bounded number of ids each.  New ids meet the filters of
their shard first; only appends with a filter that may hold a new id are read,
and of those only the id column, to settle the hits exactly.  So an append
reads in proportion to what it may repeat, not to all that is stored.

Of equal ids within an append the first in ``order`` wins: narrow columns find
it, texts do not move for it.  Null ids are never equal.  An append counts once
its manifest is written; one that broke off is written over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.session import written

SHARD_IDS, BITS_PER_ID, HASHES = 1 << 18, 10, 7
MANIFEST = "shards int, shard int, ids bigint, bits binary"


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """Bit places of 64-bit hashes in a filter of ``size`` bits (double hashing)."""
    h = h.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


def _build(t: pa.Table) -> pa.Table:
    h = t.column("h").to_numpy()
    size = max(64, -(-len(h) * BITS_PER_ID // 8) * 8)
    bits = np.zeros(size, np.uint8)
    bits[_places(h, size).ravel()] = 1
    return pa.table({"shards": t.column("shards").slice(0, 1), "shard": t.column("shard").slice(0, 1), "ids": pa.array([len(h)], pa.int64()),
                     "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _probe(new: pa.Table, filters: pa.Table) -> pa.Table:
    hits, commits = [], []
    if new.num_rows and filters.num_rows:
        h = new.column("h").to_numpy()
        for commit, data in zip(filters.column("commit").to_pylist(), filters.column("bits").to_pylist(), strict=True):
            bits = np.frombuffer(data, np.uint8)
            at = _places(h, len(bits) * 8)
            here = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1))
            hits.append(here)
            commits += [commit] * len(here)
    rows = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    return pa.table({"doc_id": new.column("doc_id").take(pa.array(rows)), "commit": pa.array(commits, pa.int32())})


def _commits(spark, table: str) -> list[int]:
    from tenderlake.streaming.streams import _commits as finished
    return finished(spark, table)


def read_table(spark, table: str) -> DataFrame | None:
    """The stored documents, with the number of their append (``commit``)."""
    folders = [f"{table}/data/commit={n}" for n in _commits(spark, table)]
    return spark.read.option("basePath", f"{table}/data").parquet(*folders) if folders else None


def append_first_writes(rows: DataFrame, table: str, order: list[str], shard_ids: int = SHARD_IDS) -> dict:
    """Append the rows whose ``doc_id`` is new; returns what was done: new
    rows, stored appends, appends read, filter hits and real ones."""
    spark = rows.sparkSession
    commits = _commits(spark, table)
    number = max(commits, default=-1) + 1
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "append-rows")
    # the first of equal ids, by narrow columns
    first = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by("_row", F.struct(*order, "_row")).alias("_row"))
    ids = written(first.withColumn("h", F.xxhash64("doc_id")), "append-ids")
    report = {"stored": len(commits), "read": 0, "hits": 0, "repeated": 0}
    known = None
    if commits:
        folders = [f"{table}/manifest/commit={n}" for n in commits]
        filters = spark.read.option("basePath", f"{table}/manifest").schema(MANIFEST + ", commit int").parquet(*folders)
        # appends of one size class share a number of shards: a bounded list
        classes = [r[0] for r in filters.select("shards").distinct().collect()]
        hits = None
        for shards in classes:
            cells = filters.filter(F.col("shards") == shards).select("shard", "commit", "bits")
            asked = ids.select("doc_id", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
            found = asked.groupBy("shard").cogroup(cells.groupBy("shard")).applyInArrow(_probe, f"doc_id {dict(rows.dtypes)['doc_id']}, commit int")
            hits = found if hits is None else hits.unionByName(found)
        hits = written(hits if hits is not None else ids.select("doc_id", F.lit(0).alias("commit")).limit(0), "append-hits")
        per = hits.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).collect()  # a row an append
        report |= {"read": len(per), "hits": sum(r["n"] for r in per)}
        if per:
            stored = spark.read.option("basePath", f"{table}/data").parquet(*[f"{table}/data/commit={r['commit']}" for r in per]).select("doc_id")
            known = written(hits.select("doc_id").distinct().join(stored, "doc_id", "left_semi"), "append-known")
            report["repeated"] = known.count()
    keep = ids.join(known, "doc_id", "left_anti") if known is not None else ids
    keep = written(keep.select("doc_id", "h", "_row"), "append-kept")
    new = rows.join(keep.select("_row").unionByName(rows.filter("doc_id is null").select("_row")), "_row", "left_semi").drop("_row")
    new.write.mode("overwrite").parquet(f"{table}/data/commit={number}")
    n = keep.count()
    # a power of two, so that appends fall into few classes
    shards = 1 << max(0, math.ceil(math.log2(max(1, n) / shard_ids)))
    (keep.select(F.lit(shards).alias("shards"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h").groupBy("shard").applyInArrow(_build, MANIFEST)
     .write.mode("overwrite").parquet(f"{table}/manifest/commit={number}"))
    return report | {"new": n}
