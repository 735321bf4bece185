"""Ingestion (batch verdicts, ids, forced metadata) and reports."""

from pyspark.sql import functions as F

from tenderlake.operators import ingest as IG
from tenderlake.operators import reports as RP


def test_blank_document_rejects_whole_batch(spark):
    docs = spark.createDataFrame([("b1", "c", "doc", 0), ("b1", "c", " \n", 1), ("b2", "c", "ok", 0)],
                                 "batch_id string, collection string, content string, pos int")
    good, bad = IG.validate_batches(docs)
    assert {r.batch_id for r in good.collect()} == {"b2"}
    assert bad.count() == 2


def test_length_mismatch_and_ids(spark):
    calls = spark.createDataFrame(
        [("b1", "historique_ao", ["a", "b"], [{"k": "v"}, {"collection": "user"}], None),
         ("b2", "historique_ao", ["a"], [{}, {}], None)],
        "batch_id string, collection string, documents array<string>, "
        "metadatas array<map<string,string>>, ids array<string>")
    rows, bad = IG.explode_batches(calls)
    assert [r.batch_id for r in bad.collect()] == ["b2"]
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    out, _ = IG.ingest(rows, None, ts)
    r = sorted(out.collect(), key=lambda x: x.pos)
    assert [x.doc_id for x in r] == ["historique_ao_1704067200000_0", "historique_ao_1704067200000_1"]
    assert r[1].extra == {} and r[0].extra == {"k": "v"}   # forced key removed from user map
    assert r[0].document_length == 1 and r[0].engine_version == "1.0.0"


def test_collections_registration_is_idempotent(spark):
    d = IG.default_collections(spark)
    names = spark.createDataFrame([("historique_ao",), ("nouvelle",)], "collection string")
    once = IG.register_collections(d, names)
    twice = IG.register_collections(once, names)
    assert once.count() == 6 and twice.count() == 6


def test_masking(spark):
    df = spark.createDataFrame([({"api_key": "sk-1234567890", "user": "bob", "auth": "abc"},)],
                               "m map<string,string>")
    r = df.select(RP.mask_map(F.col("m")).alias("m")).first().m
    assert r == {"api_key": "sk-1...7890", "user": "bob", "auth": "***"}


def test_health_rollup(spark):
    ok = spark.createDataFrame([(True,)], "h boolean")
    ko = spark.createDataFrame([(False,)], "h boolean")
    r = {x.component: x.status for x in RP.health_report([("a", ok, F.col("h")), ("b", ko, F.col("h"))]).collect()}
    assert r == {"a": "healthy", "b": "unhealthy", "overall": "unhealthy"}


def test_error_triage(spark):
    log = spark.createDataFrame([(False, 429), (False, 401), (False, 503), (False, 404)],
                                "success boolean, status_code int")
    r = {x.status_code: x for x in RP.error_triage(log).collect()}
    assert r[429].is_retryable and r[429].is_rate_limited
    assert r[401].is_authentication_error and not r[401].is_retryable
    assert r[503].is_retryable and not r[404].is_retryable
