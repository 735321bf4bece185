"""The engine's own log: counts as the run saw them, failures logged and raised."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import reports as RP
from tenderlake.operators.observed import ObservedLog
from tenderlake.sources.logs import read_log, split_corrupt


def test_runs_leave_rows(spark, tmp_path):
    log = ObservedLog(spark, f"file://{tmp_path}/log", user_id=7)
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "c")], "id bigint, text string")
    out = log.run("add_documents", df, f"file://{tmp_path}/out", text_col="text", largest=F.max("id"))
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 3] and out.schema == df.schema
    empty = log.run("rag_search", df.limit(0), f"file://{tmp_path}/none", text_col="text", hit=F.col("id") > 0)
    assert empty.count() == 0
    log.run("rag_search", df, f"file://{tmp_path}/hits", hit=F.col("id") > 0)
    with pytest.raises(Exception, match="boom"):
        log.run("broken", df.select(F.raise_error(F.lit("boom")).cast("int").alias("x")), f"file://{tmp_path}/x")
    good, bad = split_corrupt(read_log(spark, f"file://{tmp_path}/log"))
    assert bad.count() == 0
    rows = good.collect()
    first = next(r for r in rows if r.operation == "add_documents")
    assert (first.documents, first.tokens, first.cache_hit, first.success, first.user_id) == (4, 3, None, True, 7)
    assert first.context["largest"] == "3" and first.duration_ms > 0 and first.correlation_id == f"req_{first.event_id}"
    assert abs((first.ts - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 600
    assert sorted((r.documents, r.cache_hit) for r in rows if r.operation == "rag_search") == [(0, False), (4, True)]
    broken = next(r for r in rows if r.operation == "broken")
    assert not broken.success and broken.status_code == 500 and "boom" in broken.context["error"] and broken.documents is None
    stats = RP.search_stats(good).first()
    assert (stats.successful_searches, stats.failed_searches, stats.total_documents_added) == (2, 1, 8)
