"""Market analytics, exact percentiles, hybrid search and sinks."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from tenderlake.operators import market as MK
from tenderlake.operators.hybrid import reciprocal_rank_fusion


def test_exact_percentiles_match_linear_interpolation(spark):
    rnd = random.Random(5)
    rows = [(g, i, float(rnd.randint(0, 10_000))) for g in ("a", "b") for i in range(137 if g == "a" else 9)]
    rows += [("hot", i, float(i % 17)) for i in range(700)]      # one group with most rows
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {r.g: r for r in MK.exact_percentiles(df, ["g"], "v", "id").collect()}

    def pct(vals, p):
        s = sorted(vals)
        h = (len(s) - 1) * p
        lo = int(h // 1)
        hi = min(lo + 1, len(s) - 1)
        return s[lo] + (h - lo) * (s[hi] - s[lo])

    for g in ("a", "b", "hot"):
        vals = [v for gg, _, v in rows if gg == g]
        for p in MK.BANDS:
            assert abs(getattr(got[g], f"p{int(round(p * 100)):02d}") - round(pct(vals, p), 6)) < 1e-6


def test_rrf_fuses_two_lists(spark):
    bm = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, bm25_rank int")
    vec = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, cand_rank int")
    r = [x.doc_id for x in reciprocal_rank_fusion(bm, vec, 3).orderBy("rank").collect()]
    assert r == [11, 10, 12]     # 11 is in both lists


def test_route_requests(spark):
    q = spark.createDataFrame([(1, "Analyse du DCE et qualification"), (2, "prix et marge"), (3, "bonjour")],
                              "query_id long, query string")
    r = {x.query_id: x.mode for x in MK.route_requests(q).collect()}
    assert r == {1: "ANALYSE_DCE_RAG", 2: "OPTIMISATION_PRIX_RAG", 3: None}


def test_append_is_first_write_wins(spark, sf):
    out = E.queries()["s6_s8_append_read_collection"](spark, sf)
    assert out.count() == out.select("doc_id").distinct().count() > 0
    assert {r.collection for r in out.select("collection").distinct().collect()} == {"historique_ao"}


def test_hybrid_ranks(spark, sf):
    res = E.queries()["b9_hybrid_search"](spark, sf)
    per_q = res.groupBy("query_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert per_q and all(r.m == r.n <= 5 for r in per_q)


def test_generated_ids_are_unique(spark, sf):
    out = E.queries()["s2_ingest_documents"](spark, sf)
    assert out.count() == out.select("doc_id").distinct().count()
