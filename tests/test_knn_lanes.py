import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tenderlake.functions.vectors import hashed_tf
from tenderlake.operators import knn_block
from tenderlake.operators.ann import approx_candidates, with_signatures
from tenderlake.operators.knn_block import block_candidates, exact_distance


def tables(spark, n=300, dim=8, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.random((n, dim)), 1).astype(np.float32)
    x[n // 2:n // 2 + 40] = x[0]  # many copies
    x[5] = 0
    df = spark.createDataFrame([(i, "k" if i % 10 else "small", [float(v) for v in x[i]]) for i in range(n)], "doc_id bigint, _key string, embedding array<float>")
    req = df.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), "_key", F.col("embedding").alias("_qv"), F.lit(5).alias("limit"), F.lit(0.2).alias("min_similarity"))
    return x, req, df


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine", "ip"])
@pytest.mark.parametrize("k", [7, knn_block.UNLIMITED])
def test_lanes_give_what_all_pairs_give(spark, metric, k):
    x, req, df = tables(spark)
    got = {}
    for row in block_candidates(req, df, 8, metric, k, False, 17, 23).collect():
        got.setdefault(row.query_id, []).append((row.distance, row.doc_id, row.cand_rank))
    for q in range(0, len(x), 3):
        ids = np.array([i for i in range(len(x)) if (i % 10 == 0) == (q % 10 == 0)])
        d = exact_distance(metric, np.repeat(x[[q]].astype(float), len(ids), 0), x[ids].astype(float))
        want = sorted((float(a), int(b)) for a, b in zip(d, ids) if max(0.0, 1.0 - a) >= 0.2)[:k]
        mine = sorted(got.get(q, []))
        assert [m[:2] for m in mine] == want
        assert k >= knn_block.UNLIMITED or [m[2] for m in mine] == list(range(1, len(want) + 1))


def test_documents_move_once_a_lane(spark, tmp_path):
    # 20,000 requests of one key were 20 blocks of 1,024 requests before, and each had every document
    x = F.array(*[F.rand(i).cast("float") for i in range(4)])
    base = spark.range(20_000).select("id", F.lit("k").alias("_key"), x.alias("v"))
    base.write.parquet(f"{tmp_path}/v")
    base = spark.read.parquet(f"{tmp_path}/v")
    req = base.select(F.col("id").alias("query_id"), "_key", F.col("v").alias("_qv"), F.lit(1).alias("limit"), F.lit(1.0).alias("min_similarity"))
    plan = block_candidates(req, base.select(F.col("id").alias("doc_id"), "_key", F.col("v").alias("embedding")), 4, "l2sq", 1, False)
    assert plan.count() == 20_000
    assert "MapInArrow" in plan._jdf.queryExecution().toString() and "CoGroups" not in plan._jdf.queryExecution().toString()


def test_signatures_are_tested_in_the_lanes(spark):
    x, req, df = tables(spark)
    q, c = req.select("query_id", F.col("_key").alias("collection"), F.col("_qv").alias("q_vec")), df.select("doc_id", F.col("_key").alias("collection"), "embedding")
    plan = approx_candidates(q, c, 8, k=4, bands=3, bits=4)
    assert "_sig," not in plan._jdf.queryExecution().toString()
    sigs = {r.doc_id: r._sigs for r in with_signatures(df, "embedding", 8, 3, 4).collect()}
    got = {}
    for r in plan.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    for i in range(0, len(x), 3):
        near = []
        for j in range(len(x)):
            if (i % 10 == 0) == (j % 10 == 0) and any(a == b for a, b in zip(sigs[i], sigs[j], strict=True)):
                d = float(exact_distance("l2sq", x[[i]].astype(float), x[[j]].astype(float))[0])
                if max(0.0, 1.0 - d) >= 0.5:
                    near.append((d, j))
        assert [d for _, d in sorted(got.get(i, []))] == [j for _, j in sorted(near)[:4]]


def test_hashed_tf_over_arrow(spark):
    texts = [None, "", "  ", "a\x1cb c", "A\xa0b C\x85d", "x\x1e\x1e y", "b a B A b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_tf(F.col("t"), 64).alias("v"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().toString()
    v = [r.v for r in df.collect()]
    assert [sum(c > 0 for c in x) for x in v] == [0, 0, 0, 2, 4, 2, 2] and all(len(x) == 64 for x in v)
    assert sorted(c for c in v[-1] if c) == pytest.approx([2 / 13 ** 0.5, 3 / 13 ** 0.5])


def test_rows_that_come_twice_are_one_neighbour(spark):
    _, req, df = tables(spark)
    q, c = req.select("query_id", F.col("_key").alias("collection"), F.col("_qv").alias("q_vec")), df.select("doc_id", F.col("_key").alias("collection"), "embedding")
    once, twice = (sorted(map(tuple, approx_candidates(a, b, 8, k=4).collect())) for a, b in ((q, c), (q.union(q), c.union(c))))
    assert once == twice


def test_lanes_do_not_grow_with_the_shuffle_partitions(spark, tmp_path, monkeypatch):
    # with 400 partitions 20,000 requests were 79 lanes before, and each had every document
    class Copies(knn_block._Kernel):
        def __call__(self, batches):
            n = sum(int((rb.column("_side").to_numpy() == 1).sum()) for rb in batches)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([1], pa.int32()), pa.array([0.0]), pa.array([0.0]), pa.array([0]), pa.array([1], pa.int32())],
                                             schema=to_arrow_schema(self.out))

    monkeypatch.setattr(knn_block, "_Kernel", Copies)
    base = spark.range(20_000).select("id", F.lit("k").alias("_key"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("v"))
    base.write.parquet(f"{tmp_path}/v")
    base = spark.read.parquet(f"{tmp_path}/v")
    req = base.select(F.col("id").alias("query_id"), "_key", F.col("v").alias("_qv"), F.lit(1).alias("limit"), F.lit(1.0).alias("min_similarity"))
    docs = base.filter("id < 50").select(F.col("id").alias("doc_id"), "_key", F.col("v").alias("embedding"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        copies = [r.query_id for r in block_candidates(req, docs, 2, "l2sq", 1, False).collect() if r.query_id]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lanes = knn_block.LANES_PER_CORE * spark.sparkContext.defaultParallelism
    assert sum(copies) <= 50 * lanes
    assert set(copies) == {50}  # every lane has a task of its own


def test_exact_distances_are_summed_left_to_right():
    r = np.random.default_rng(5)
    q, v = (r.random((3000, 64)).astype(np.float32) for _ in range(2))
    for metric in ("l2sq", "ip"):
        want = []
        for a, b in zip(q.astype(float).tolist(), v.astype(float).tolist()):
            terms = [(x - y) * (x - y) if metric == "l2sq" else x * y for x, y in zip(a, b)]
            total = terms[0]
            for t in terms[1:]:
                total += t
            want.append(total if metric == "l2sq" else 1.0 - total)
        assert exact_distance(metric, q, v).tolist() == want
