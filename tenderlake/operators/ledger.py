"""Embedding calls that survive task retries (E2): a ledger of finished chunks.

Distinct texts without a stored vector are dealt to ``concurrency`` partitions,
each of which calls the model for one chunk of ``chunk_rows`` texts at a time;
so at most that many calls run at once.  A finished chunk is written to the
ledger by the task itself, under the digest of its contents and with a rename at
the end, before the next one starts.  A task that runs again finds the chunks it
has finished and calls the model for the rest only; so does a job that runs
again after an error.  The first error of a call fails the job.

The ledger is a Parquet folder (digest, model, embedding) below the shared
folder; the result is the texts joined to it by digest.  A null text counts as
the empty one; rows that repeat share a vector.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = "digest string, model string, embedding array<float>"


def _store(uri: str):
    """File system and path of a folder, in the driver or in a task."""
    import pyarrow.fs as pafs
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def finish_chunk(uri: str, digests: list[str], texts: list[str], fn: Callable[[list[str]], np.ndarray], model: str, dim: int) -> bool:
    """Call the model for one chunk and store it; False if it was stored already."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    fs, folder = _store(uri)
    name = hashlib.sha256("".join([model, *digests]).encode()).hexdigest()
    path = f"{folder}/chunk-{name}.parquet"
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        return False
    vectors = np.asarray(fn(texts), np.float32).reshape(len(texts), dim)
    table = pa.table({"digest": pa.array(digests), "model": pa.array([model] * len(digests)),
                      "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dim).cast(pa.list_(pa.float32()))})
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/_{uuid.uuid4().hex}"  # readers skip names that begin with an underscore
    pq.write_table(table, part, filesystem=fs)
    fs.move(part, path)
    return True


def read_ledger(spark, uri: str, model: str) -> DataFrame:
    """(digest, embedding) of the finished chunks, a row a digest."""
    import pyarrow.fs as pafs
    fs, folder = _store(uri)
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], "digest string, embedding array<float>")
    stored = spark.read.schema(LEDGER).parquet(uri).filter(F.col("model") == model)
    # chunks of broken runs may hold a digest twice, with equal vectors
    return stored.groupBy("digest").agg(F.first("embedding").alias("embedding"))


def embed_with_ledger(df: DataFrame, text_col: str, fn: Callable[[list[str]], np.ndarray], dim: int, model: str, uri: str,
                      chunk_rows: int = 100, concurrency: int = 16, out_col: str = "embedding") -> DataFrame:
    """``df`` with a vector for every text, calling ``fn`` only for distinct
    texts that the ledger at ``uri`` does not hold."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    new = (df.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
           .join(read_ledger(spark, uri, model).select("digest"), "digest", "left_anti"))

    def call(batches):
        called = 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                called += finish_chunk(uri, part.column("digest").to_pylist(), part.column("text").to_pylist(), fn, model, dim)
        yield pa.RecordBatch.from_arrays([pa.array([called], pa.int64())], ["calls"])

    # sorted, so that a task that runs again forms the same chunks
    new.repartition(concurrency, "digest").sortWithinPartitions("digest").mapInArrow(call, "calls bigint").agg(F.sum("calls")).collect()
    a, b = df.withColumn("_digest", digest).alias("a"), read_ledger(spark, uri, model).alias("b")
    return a.join(b, F.col("a._digest") == F.col("b.digest")).select(*[F.col(f"a.`{c}`") for c in df.columns], F.col("b.embedding").alias(out_col))
