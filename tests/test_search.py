"""Search: validation, enrichment, relevance, kernels and result properties."""

import pytest
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.profile import enrich_query
from tenderlake.operators.providers import HashedTF
from tenderlake.operators.search import (SearchOptions, contextual_relevance, knn_candidates,
                                         prepare_requests, rerank, result_columns, search,
                                         validate_requests, wrong_dimension)
from tenderlake.sources import fixtures as fx

CTX = "struct<ao_type:string,sector:string,estimated_amount:bigint,technical_domains:array<string>,organisme:string>"


def test_request_validation(spark):
    rows = [(1, "  \n\t", 5, 0.5), (2, "ok", 0, 0.5), (3, "ok", 101, 0.5), (4, "ok", 5, -0.1),
            (5, "ok", 5, 1.1), (6, "ok", 100, 0.0), (7, "ok", 1, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, query string, limit int, min_similarity double")
    r = {x.query_id: x.reject_reason for x in validate_requests(df).collect()}
    assert r[1] == "EMPTY_QUERY"
    assert r[2] == r[3] == "VALUE_OUT_OF_RANGE:limit"
    assert r[4] == r[5] == "VALUE_OUT_OF_RANGE:min_similarity"
    assert r[6] is None and r[7] is None


def test_enrichment(spark):
    df = spark.createDataFrame(
        [("plateforme", ("Ouvert", "Territorial", 750000, ["Développement", "Data/IA"], "Région X")),
         ("plateforme", None)], f"q string, ctx {CTX}")
    r = df.select(enrich_query(F.col("q"), F.col("ctx")).alias("e")).collect()
    e = r[0].e
    for frag in ["plateforme", "appel offres Ouvert", "secteur Territorial", "montant 500k-1M",
                 "technologies Développement Data/IA", "organisme Région X"]:
        assert frag in e
    assert r[1].e == "plateforme"


def test_relevance_cap_and_no_context(spark):
    df = spark.createDataFrame(
        [(0.8, "Territorial", "Ouvert", "500k-1M", "Région Bretagne",
          ("Ouvert", "Territorial", 500000, [], "Conseil régional Région")),
         (0.8, "Territorial", "Ouvert", "500k-1M", "x", None),
         (0.5, "État", "MAPA", "0-25k", "CHU de Nantes", ("Ouvert", "Territorial", 0, [], "chu"))],
        f"sim double, secteur string, type_ao string, fourchette_montant string, organisme string, ctx {CTX}")
    r = df.select(contextual_relevance(F.col("sim"), F.col("ctx")).alias("r")).collect()
    assert r[0].r == 1.0          # 0.8 + 0.33 capped
    assert r[1].r == 0.8          # no context: base similarity
    assert abs(r[2].r - 0.55) < 1e-12  # only the buyer-kind bonus ("chu" as a substring)


def test_kernels_agree_and_properties(spark, sf):
    corp = fx.corpus(spark, sf)
    good, _ = prepare_requests(fx.document_queries(spark, sf), HashedTF())
    a = knn_candidates(good, corp, 64, SearchOptions(kernel="join"))
    b = knn_candidates(good, corp, 64, SearchOptions(kernel="block"))
    key = lambda df: sorted((r.query_id, r.doc_id, r.cand_rank, round(r.similarity, 9))
                            for r in df.select("query_id", "doc_id", "cand_rank", "similarity").collect())
    assert key(a) == key(b)
    res = result_columns(rerank(a)).collect()
    assert res, "flagship returns rows"
    by_q = {}
    for r in res:
        by_q.setdefault(r.query_id, []).append(r)
        assert r.similarity_score >= 0.5 and 0.0 <= r.relevance_score <= 1.0
    for rows in by_q.values():
        assert sorted(x.rank for x in rows) == list(range(1, len(rows) + 1))
        assert len(rows) <= 5


def test_candidates_then_rerank_window(spark, sf):
    """A better-bonus row beyond 2·limit candidates never appears."""
    corp = fx.corpus(spark, sf)
    req = fx.conversation_queries(spark, sf, limit=2, min_similarity=0.0)
    good, _ = prepare_requests(req, HashedTF())
    c = knn_candidates(good, corp, 64, SearchOptions(metric="cosine"))
    assert c.agg(F.max("cand_rank")).first()[0] <= 4
    res = search(req, corp, opts=SearchOptions(metric="cosine"))
    ids = {(r.query_id, r.doc_id) for r in res.collect()}
    cids = {(r.query_id, r.doc_id) for r in c.collect()}
    assert ids <= cids


def test_user_filter_overrides_context(spark, sf):
    corp = fx.corpus(spark, sf)
    opts = SearchOptions(filters={"type_ao": {"$in": S.AO_TYPES[:3]}})
    res = search(fx.document_queries(spark, sf), corp, opts=opts).collect()
    assert all(r.ao_type in S.AO_TYPES[:3] for r in res)


def _candidates(df):
    return sorted((r.query_id, r.doc_id, r.cand_rank, r.distance) for r in df.select("query_id", "doc_id", "cand_rank", "distance").collect())


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine", "ip"])
def test_kernels_give_the_same_rows_on_copies(spark, sf, metric):
    """Exact copies of vectors at an inclusive cut and at ties: the pair join,
    the blocks, and many small blocks agree to the last bit."""
    corp = fx.corpus(spark, sf)
    three = corp.unionByName(corp.withColumn("doc_id", F.col("doc_id") + 100000)).unionByName(
        corp.withColumn("doc_id", F.col("doc_id") + 200000))
    plain = fx.corpus(spark, sf).select(F.col("doc_id").alias("query_id"), "collection", F.col("embedding").alias("q_vec"),
                                        F.lit(2).alias("limit"), F.lit(None).cast(S.CONTEXT_TYPE).alias("ctx"))
    for cut in (1.0, 0.9, 0.0):
        req = plain.withColumn("min_similarity", F.lit(cut))
        join = _candidates(knn_candidates(req, three, 64, SearchOptions(metric=metric, kernel="join")))
        assert join == _candidates(knn_candidates(req, three, 64, SearchOptions(metric=metric)))
        assert join == _candidates(knn_candidates(req, three, 64, SearchOptions(metric=metric, request_block=7, corpus_block=11)))
        assert len(join) > 0 or metric == "ip" or metric == "cosine"
    if metric == "l2sq":
        full = knn_candidates(plain.withColumn("min_similarity", F.lit(1.0)), three, 64, SearchOptions())
        assert full.filter("distance > 0").count() == 0 and full.count() >= 3 * plain.count()


def test_contexts_in_small_blocks(spark, sf):
    good, _ = prepare_requests(fx.document_queries(spark, sf), HashedTF())
    corp = fx.corpus(spark, sf)
    a = _candidates(knn_candidates(good, corp, 64, SearchOptions(kernel="join")))
    assert a == _candidates(knn_candidates(good, corp, 64, SearchOptions(request_block=2, corpus_block=3))) and a


def test_limits_and_dimensions(spark, sf):
    corp = fx.corpus(spark, sf)
    req = fx.conversation_queries(spark, sf, limit=100, min_similarity=0.0)
    good, _ = prepare_requests(req, HashedTF())
    n = corp.filter(F.col("collection") == S.DEFAULT_COLLECTION).count()
    c = knn_candidates(good, corp, 64)
    assert c.count() == min(200, n) * good.count()
    with pytest.raises(ValueError):
        knn_candidates(good.withColumn("limit", F.lit(120)), corp, 64)
    short = corp.withColumn("embedding", F.when(F.col("doc_id") % 2 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    for kernel in ("block", "join"):
        assert knn_candidates(good, short, 64, SearchOptions(kernel=kernel)).filter("doc_id % 2 = 0").count() == 0
    assert wrong_dimension(short, 64).count() == corp.filter("doc_id % 2 = 0").count()


def test_requests_with_null_keys_meet_nothing(spark, sf):
    corp = fx.corpus(spark, sf).withColumn("secteur", F.lit(None).cast("string"))
    good, _ = prepare_requests(fx.document_queries(spark, sf), HashedTF())
    assert knn_candidates(good, corp, 64).count() == 0
    assert knn_candidates(good.limit(0), corp, 64).count() == 0
