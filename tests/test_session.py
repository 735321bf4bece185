"""Shared folder and shipped code."""

import subprocess
import sys

import pytest

from tenderlake import session
from tenderlake.operators.blocks import block_join, checked_broadcast


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master = "spark://host:7077"

    def getConf(self):
        return _Conf()

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Context()


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(_Session())


def test_workers_get_the_package(tmp_path):
    """A job started elsewhere, with the entry's path line only."""
    root = session.__file__.rsplit("/", 2)[0]
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", E.queries()["e3_precomputed_vector_search"](spark, "/root/testdata/sf0.001").count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 1000" in out.stdout, out.stderr[-2000:]


def test_block_join_meets_every_pair_once(spark):
    import pyarrow as pa
    a = spark.createDataFrame([(i, None if i == 99 else i % 3) for i in range(100)], "a bigint, k bigint")
    b = spark.createDataFrame([(i, None if i == 7 else i % 2) for i in range(40)], "b bigint, k bigint")

    def pairs(left, right):
        x, y = left.column("a").to_pylist(), right.column("b").to_pylist()
        both = [(i, j) for i in x for j in y]
        return pa.table({"a": pa.array([i for i, _ in both], pa.int64()), "b": pa.array([j for _, j in both], pa.int64())})

    got = block_join(a, b, "k", "a", "b", pairs, "a bigint, b bigint", 7, 3).collect()
    want = [(r.a, r.b) for r in a.join(b, "k").collect()]
    assert sorted((r.a, r.b) for r in got) == sorted(want) and len(want) > 500


def test_broadcast_only_below_the_budget(spark):
    df = spark.range(1000)  # 16 bytes a row are counted
    assert "broadcast" in checked_broadcast(df)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in checked_broadcast(df, budget=100)._jdf.queryExecution().toString().lower()
