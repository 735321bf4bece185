"""Exact top-k by inner product of quantised vectors, by columnar branch and bound.

Candidates and queries are dealt to blocks; every query block meets every
candidate block (a stated query set against all rows).  Within a pair of
blocks the candidates lie in columns: scores grow block by block of
dimensions, and by Cauchy-Schwarz the dimensions not yet read can move a
score by at most |rest of query| * |rest of candidate|.  A candidate whose
upper bound lies under the k-th best lower bound of a query is dropped for
that query, and the survivors are compacted before the next dimensions.  Each
pair of blocks passes on k rows a query; the k best over all blocks remain.

Defined results: vectors that are null or hold null, NaN or infinite
components, and rows with a null id, take no part.  A query's own rows are
all rows with its id; rows that repeat (id and vector) count once.  Only
vectors of the query's dimension are candidates.  Ties go to the smaller id.
An empty table gives none; other columns are ignored.  Scores are exact while
they stay within 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import written

SCALE = 256
TOP = 5
CANDIDATE_BLOCK = 1024
QUERY_BLOCK = 512
DIMS = 8
#: Below this share of pairs alive, single pairs are followed instead of blocks.
SPARSE = 0.2

HITS = "query_id bigint, vec_id bigint, score bigint"


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in a block,
    ties to the smaller candidate id; candidates with the query's id excluded."""
    n_q, n_c, dims = len(q), len(c), q.shape[1]
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dims, 1)
    kind = np.float64 if peak < 2 ** 52 else np.int64
    # dimensions with the largest products first, candidates in columns
    order = np.argsort(-(q.astype(np.float64) ** 2).sum(0) * (c.astype(np.float64) ** 2).sum(0), kind="stable")
    q, cols = q[:, order].astype(kind), np.ascontiguousarray(c[:, order].T.astype(kind))
    q_rest = np.sqrt(np.maximum((q.astype(np.float64) ** 2)[:, ::-1].cumsum(1)[:, ::-1], 0))
    c_rest = np.sqrt(np.maximum((cols.astype(np.float64) ** 2)[::-1].cumsum(0)[::-1], 0))
    own = q_ids[:, None] == c_ids[None, :]
    alive = ~own
    score = np.zeros((n_q, n_c), kind)
    at = 0
    while at < dims:  # whole blocks, columns of candidates that no query needs are compacted away
        end = min(at + DIMS, dims)
        score += q[:, at:end] @ cols[at:end]
        at = end
        if at < dims and n_c > k:
            slack = q_rest[:, at, None] * c_rest[at][None, :] * (1 + 1e-9) + 1e-6
            low = np.where(alive, score - slack, -np.inf)
            floor = np.partition(low, n_c - k, axis=1)[:, n_c - k]
            alive &= score + slack >= floor[:, None]
            some = alive.any(axis=0)
            if some.sum() < 0.8 * n_c and some.sum() > k:
                score, alive, cols, c_rest, c_ids = score[:, some], alive[:, some], cols[:, some], c_rest[:, some], c_ids[some]
                c = c[some]
                n_c = len(c_ids)
            if alive.mean() < SPARSE:
                break
    qi, ci = np.nonzero(alive)
    part = score[qi, ci]
    while at < dims:  # the few pairs left, one row each
        end = min(at + DIMS, dims)
        part = part + (q[qi, at:end] * cols[at:end, ci].T).sum(1)
        at = end
        if at < dims:
            slack = q_rest[qi, at] * c_rest[at, ci] * (1 + 1e-9) + 1e-6
            by = np.lexsort((-(part - slack), qi))
            starts = np.searchsorted(qi[by], np.arange(n_q))
            counts = np.diff(np.append(starts, len(by)))
            floor = np.full(n_q, -np.inf)
            enough = counts >= k
            floor[enough] = (part - slack)[by][starts[enough] + k - 1]
            keep = part + slack >= floor[qi]
            qi, ci, part = qi[keep], ci[keep], part[keep]
    by = np.lexsort((c_ids[ci], -part, qi))
    qi, ci, part = qi[by], ci[by], part[by]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    best = rank < k
    return qi[best], c_ids[ci[best]], part[best].astype(np.int64)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("q").combine_chunks()
    width = table.column("dim")[0].as_py() if len(ids) else 0
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
    if len(np.unique(ids)) < len(ids):  # rows that repeat count once
        both = np.unique(np.concatenate([ids[:, None], x], axis=1), axis=0)
        ids, x = both[:, 0], both[:, 1:]
    return ids, x


def exact_topk(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP,
               scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row that
    ``is_query`` (a condition on ``vec_id``) against all other rows."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).filter(
        F.col("vec_id").isNotNull() & usable("v"))
    v = written(v.select("vec_id", quantised("v", scale).alias("q"), F.size("v").alias("dim")), "topk-vectors")
    q = v.filter(is_query)
    n = v.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(is_query, 1)), F.lit(0)).alias("q")).first()
    n_c, n_q = max(1, -(-n["n"] // candidate_block)), max(1, -(-n["q"] // query_block))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, salt: int) -> DataFrame:
        return df.select("vec_id", "q", "dim", F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n_own)).cast("bigint").alias(own),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))).alias(other))

    def pair(left, right):
        q_ids, qx = _matrix(left)
        c_ids, cx = _matrix(right)
        if not len(q_ids) or not len(c_ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        qi, ids, score = block_topk(q_ids, qx, c_ids, cx, k)
        return pa.table({"query_id": q_ids[qi], "vec_id": ids, "score": score})

    keys = ["dim", "qb", "cb"]
    hits = (dealt(q, "qb", n_q, "cb", n_c, 1).groupBy(*keys)
            .cogroup(dealt(v, "cb", n_c, "qb", n_q, 2).groupBy(*keys)).applyInArrow(pair, HITS))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
