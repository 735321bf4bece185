"""Bucketed cache table: same rows as the plain probe, no exchange of the cache."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.vectors import _words, text_vectors, tf_vectors
from tenderlake.operators import cache as C

T0 = dt.datetime(2024, 1, 1)
AS_OF = "2024-01-01 12:00:00"


def entries(spark, rows):
    df = spark.createDataFrame(rows, "text string, cached_at timestamp")
    return C.make_entries(df.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "m", F.col("cached_at"))


@pytest.fixture
def table(spark, tmp_path):
    return C.open_bucketed_cache(spark, f"file://{tmp_path}/cache")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probe_equals_the_plain_one(spark, table):
    as_of = F.lit(AS_OF).cast("timestamp")
    first = entries(spark, [(f"t{i % 40}", T0 + dt.timedelta(minutes=i)) for i in range(120)] + [("old", T0 - dt.timedelta(days=2)), ("a b", T0)])
    second = entries(spark, [("t1", T0 + dt.timedelta(hours=3)), ("new", T0)])
    C.append_bucketed(first, table)
    C.append_bucketed(second, table)
    texts = [(i, f"t{i % 60}") for i in range(100)] + [(200 + i, "t3") for i in range(50)] \
        + [(300, None), (301, ""), (302, "a  b"), (303, "a b"), (304, "old"), (305, "new")]
    t = spark.createDataFrame(texts, "pos bigint, text string").withColumn("embedding", F.lit("a clashing name"))
    plain = C.probe(t, first.unionByName(second), "m", as_of)
    mine = C.probe_bucketed(t.drop("embedding"), table, "m", as_of)
    key = lambda df: sorted((r.pos, str(r.cache_key), r.status, r.embedding) for r in df.collect())
    assert key(mine) == key(plain)
    assert {r.pos: r.status for r in mine.collect()}[302] == "corrupt"
    newest = {r.cache_key: r.cached_at for r in C.latest_entries(spark.table(table)).collect()}
    assert newest == {r.cache_key: r.cached_at for r in C.latest_entries(first.unionByName(second)).collect()}


def test_the_cache_is_not_shuffled(spark, table):
    C.append_bucketed(entries(spark, [(f"t{i}", T0) for i in range(50)]), table)
    assert "Exchange" not in executed(C.latest_entries(spark.table(table)))
    t = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "pos bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(C.probe_bucketed(t, table, "m", F.lit(AS_OF).cast("timestamp")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    upto = next(i for i, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[:upto]) and "Bucketed: true" in lines[scan]


def test_reopened_in_another_session(spark, tmp_path):
    uri = f"file://{tmp_path}/cache"
    name = C.open_bucketed_cache(spark, uri, 5)
    big = entries(spark, [("x", T0), ("huge", T0)]).withColumn(
        "size_bytes", F.when(F.col("text") == "huge", S.CACHE_ENTRY_MAX_BYTES + 1).otherwise(F.col("size_bytes")))
    C.append_bucketed(big, name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it, the files stay
    assert C.open_bucketed_cache(spark, uri, 9) == name
    assert [r.text for r in spark.table(name).collect()] == ["x"]
    assert spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()["data_type"] == "5"
    empty = spark.createDataFrame([], "pos bigint, text string")
    assert C.probe_bucketed(empty, name, "m", F.lit(AS_OF).cast("timestamp")).count() == 0


def counting(path):
    """A column of texts that passes its rows on and leaves their number at ``path``."""
    @F.arrow_udf("string")
    def same(texts: pa.Array) -> pa.Array:
        with open(path, "a") as f:
            f.write(f"{len(texts)}\n")
        return texts

    return same


def test_texts_are_hashed_once(spark, table, tmp_path):
    C.append_bucketed(entries(spark, [("t1", T0)]), table)
    texts = spark.createDataFrame([(i, f"t{i % 9}") for i in range(60)], "pos bigint, text string")
    seen = f"{tmp_path}/seen"
    got = C.probe_bucketed(texts.withColumn("text", counting(seen)("text")), table, "m", F.lit(AS_OF).cast("timestamp")).collect()
    assert sorted(r.pos for r in got if r.status == "hit") == [i for i in range(60) if i % 9 == 1]
    assert sum(int(x) for x in open(seen)) == 60


def test_vectors_are_computed_once(spark, table, tmp_path):
    """The size cap reads the size of the vectors."""
    seen = f"{tmp_path}/seen"
    texts = spark.createDataFrame([(f"t{i}",) for i in range(40)] + [("x" * (S.CACHE_ENTRY_MAX_BYTES + 1),)], "text string")
    vectors = F.transform(F.array(counting(seen)("text")), lambda x: F.length(x).cast("float"))
    new = C.make_entries(texts.withColumn("embedding", vectors), "m", F.lit(AS_OF).cast("timestamp"))
    C.append_bucketed(new, table)
    assert sorted(r.text for r in spark.table(table).collect()) == sorted(f"t{i}" for i in range(40))
    assert sum(int(x) for x in open(seen)) == 41


def test_an_older_version_stays_where_the_newest_is_too_large(spark, table):
    both = entries(spark, [("a", T0), ("a", T0 + dt.timedelta(hours=1)), ("b", T0), (None, T0)])
    late = F.col("cached_at") > F.lit(T0)
    C.append_bucketed(both.withColumn("size_bytes", F.when(late, S.CACHE_ENTRY_MAX_BYTES + 1).otherwise(F.col("size_bytes"))), table)
    assert sorted((str(r.text), r.cached_at) for r in spark.table(table).collect()) == [("a", T0), ("b", T0)]


def test_known_keys_are_kept(spark):
    texts = spark.createDataFrame([("k", "a  b")], "known string, text string").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    of = lambda **kw: C.make_entries(texts, "m", F.lit(AS_OF).cast("timestamp"), **kw).first()
    assert of(key_col="known").cache_key == "k" and of(key_col="known").key_prefix == "k" and len(of().cache_key) == 64


def test_vectors_of_arrow_texts_equal_those_of_word_lists():
    texts = ["", " ", "a b  a\tc\n", "é ß x", "a\x1cb a", "a\xa0b\u3000c\u200bd", "\x85", "one", "  two words "] * 3
    for dim in (7, 64):
        new, old = text_vectors(pa.array(["skipped", *texts], pa.string()).slice(1), dim), tf_vectors([_words(t) for t in texts], dim)
        assert new.dtype == old.dtype and np.array_equal(new, old)
    assert text_vectors(pa.array([], pa.string()), 64).shape == (0, 64)
