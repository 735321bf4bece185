"""Embedding providers: DataFrame → DataFrame transforms adding a vector column.

* ``HashedTF``     a column over Arrow batches, per row, no shuffle (64 dims default)
* ``Precomputed``  equi-join with a vector table on a key
* ``ArrowProvider`` a user function over Arrow batches (``mapInArrow``), for
  real embedding models; Spark tasks give the concurrency, Arrow batches the
  request batching.  ``ledger.embed_with_ledger`` keeps finished calls.

Every provider states its model's dimension, token limit and price, and
estimates what a table of texts would cost.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S
from tenderlake.functions.text import word_count
from tenderlake.functions.vectors import hashed_tf, tf_vectors


class Provider:
    name = "provider"
    dim = 0
    model = "hashed-tf"

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        raise NotImplementedError

    @property
    def max_tokens(self) -> int | None:
        """Token limit of a text; None where the model is not a known one."""
        return next((t for m, _, _, t in S.MODELS if m == self.model), None)

    @property
    def price_per_1k(self) -> float:
        return next((p for m, _, p, _ in S.MODELS if m == self.model), S.UNKNOWN_MODEL_PRICE)

    def info(self) -> dict:
        return {"provider": self.name, "model": self.model, "dimension": self.dim, "max_tokens": self.max_tokens, "price_per_1k": self.price_per_1k}

    def estimate(self, df: DataFrame, text_col: str) -> DataFrame:
        """One row: texts, tokens (words x 1.3, truncated on the total), texts
        over the model's limit, and cost."""
        words = word_count(F.col(text_col))
        over = words.cast("double") * F.lit(S.TOKENS_PER_WORD) > F.lit(self.max_tokens) if self.max_tokens else F.lit(False)
        g = df.agg(F.count(F.lit(1)).alias("texts"), F.floor(F.coalesce(F.sum(words), F.lit(0)).cast("double") * F.lit(S.TOKENS_PER_WORD)).cast("bigint").alias("tokens"),
                   F.count_if(over).alias("over_limit"))
        return g.select("texts", "tokens", "over_limit", F.round(F.col("tokens").cast("double") / F.lit(1000.0) * F.lit(self.price_per_1k), 9).alias("cost_usd"))


class HashedTF(Provider):
    name = "hashed_tf"

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.model = f"hashed-tf-{dim}"

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return df.withColumn(out_col, hashed_tf(F.col(text_col), self.dim))


class Precomputed(Provider):
    """Vectors looked up in a table ``(key, embedding)`` by an id column."""
    name = "precomputed"

    def __init__(self, vectors: DataFrame, key: str, vec_col: str = "embedding", dim: int = 64,
                 model: str = "precomputed"):
        self.vectors = vectors.select(F.col(key).alias("_pk"), F.col(vec_col).alias("_pv"))
        self.dim = dim
        self.model = model

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding",
              id_col: str = "query_id") -> DataFrame:
        out = df.join(self.vectors, df[id_col] == F.col("_pk"))
        return out.drop("_pk").withColumnRenamed("_pv", out_col)


class ArrowProvider(Provider):
    """Wrap ``fn(list[str]) -> np.ndarray[n, dim]`` as a batched Arrow transform."""
    name = "arrow"

    def __init__(self, fn: Callable[[list], np.ndarray], dim: int, model: str = "user",
                 batch_rows: int = 100):
        self.fn = fn
        self.dim = dim
        self.model = model
        self.batch_rows = batch_rows

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        fn, dim, n = self.fn, self.dim, self.batch_rows
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def run(batches):
            for rb in batches:
                for off in range(0, rb.num_rows, n):
                    part = rb.slice(off, n)
                    texts = part.column(text_col).to_pylist()
                    vecs = np.asarray(fn(texts), dtype=np.float32).reshape(len(texts), dim)
                    arr = pa.FixedSizeListArray.from_arrays(pa.array(vecs.ravel()), dim) \
                        .cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays(part.columns + [arr],
                                                     names=part.schema.names + [out_col])

        return df.mapInArrow(run, schema)


def hashed_tf_numpy(texts: list, dim: int = 64) -> np.ndarray:
    """The hashed term-frequency vectors of ``HashedTF`` as a function of texts
    (a stand-in for a user model behind ``ArrowProvider``)."""
    return tf_vectors([(t or "").lower().split() for t in texts], dim)
