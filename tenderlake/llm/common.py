"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.session import ensure_checkpoint_dir, scratch_path

#: Texts that a task works on at once.
BATCH_BYTES = 8 << 20
#: Arrow batches between the JVM and Python; long texts make the default of
#: 10,000 rows large.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: White space of the word rules in the contracts: space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """The shared folder, and Arrow batches that do not exceed a task's own."""
    ensure_checkpoint_dir(spark)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES // 2))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``written`` returned, once
    nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/tables/" not in folder:
            continue
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def as_text(column: str = "text"):
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str, mod: int, rest: int):
    """Whether crc32 of the id's decimal text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % mod == rest, F.lit(False))


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Split a batch so that no piece holds much more than ``BATCH_BYTES`` of
    ``column`` (one very long text is a piece by itself)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null as the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


_HELD: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What an operator keeps between batches and tasks in a Python worker.
    Workers are used again, by other operators too: each holds one cache, and
    an operator that asks for its own drops the one before."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release_cache() -> None:
    _HELD.clear()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str = "text",
                keeps_cache: bool = False) -> DataFrame:
    """``fn`` over the pieces of every batch."""
    def run(batches):
        if not keeps_cache:
            release_cache()
        for batch in batches:
            for piece in chunks(batch, text):
                yield fn(piece)

    return df.mapInArrow(run, schema)
