"""First write wins over appends, with Bloom filters in front of the stored ids."""

import random

from pyspark.sql import functions as F

from tenderlake.operators.first_write import append_first_writes, read_table

SCHEMA = "doc_id string, content string, at int, commit_note string"


def test_appends_against_plain(spark, tmp_path):
    r = random.Random(1)
    table, want, reports = f"{tmp_path}/table", {}, []
    for n in range(5):
        rows = [(f"id-{r.randrange(900)}", f"{n}:{i}", r.randrange(50), "x") for i in range(300)] + [(None, f"{n}:null", 1, "x")] * 2
        rows += [("hot", f"{n}:hot{i}", 60 - i, "x") for i in range(50)]
        first = {}
        for d, c, at, _ in rows:
            if d is not None and (d not in first or (at, c) < first[d]):
                first[d] = (at, c)
        for d, (_, c) in first.items():
            want.setdefault(d, c)
        reports.append(append_first_writes(spark.createDataFrame(rows, SCHEMA).repartition(4), table, ["at", "content"], shard_ids=40))
    got = read_table(spark, table)
    assert {x.doc_id: x.content for x in got.filter("doc_id is not null").collect()} == want
    assert got.filter("doc_id is not null").count() == len(want) and got.filter("doc_id is null").count() == 10
    assert reports[0]["read"] == 0 and all(x["hits"] >= x["repeated"] > 0 for x in reports[1:])
    # false hits are few, and settled
    assert sum(x["hits"] - x["repeated"] for x in reports) < 100


def test_appends_that_share_nothing_are_not_read(spark, tmp_path):
    table = f"{tmp_path}/table"
    for n in range(4):
        report = append_first_writes(spark.range(n * 2000, n * 2000 + 2000).select(F.col("id").alias("doc_id"), F.lit(n).alias("at")), table, ["at"])
        assert report["new"] == 2000 and report["hits"] < 200
    again = append_first_writes(spark.range(2000, 2010).select(F.col("id").alias("doc_id"), F.lit(9).alias("at")), table, ["at"])
    assert again["new"] == 0 and again["repeated"] == 10 and again["read"] <= 2
    # an append that broke off before its manifest does not count, and is written over
    spark.range(5).select(F.col("id").alias("doc_id"), F.lit(1).alias("at")).write.parquet(f"{table}/data/commit=5")
    assert read_table(spark, table).count() == 8000
    assert append_first_writes(spark.range(8000, 8001).select(F.col("id").alias("doc_id"), F.lit(1).alias("at")), table, ["at"])["new"] == 1
    assert read_table(spark, table).count() == 8001


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, at int")
    assert append_first_writes(none, f"{tmp_path}/t", ["at"])["new"] == 0
    assert append_first_writes(none, f"{tmp_path}/t", ["at"])["new"] == 0 and read_table(spark, f"{tmp_path}/t").count() == 0
