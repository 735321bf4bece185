"""Tender profile columns: bucket boundaries, formalism, price sensitivity,
complexity, keywords, weight check."""

from pyspark.sql import functions as F

from tenderlake.functions import profile as P
from tenderlake.operators.profile import profile_tenders, split_valid_tenders

AMOUNTS = [(0, "0-25k"), (24999, "0-25k"), (25000, "25k-100k"), (99999, "25k-100k"),
           (100000, "100k-500k"), (499999, "100k-500k"), (500000, "500k-1M"), (750000, "500k-1M"),
           (999999, "500k-1M"), (1000000, "1M-5M"), (1000001, "1M-5M"), (4999999, "1M-5M"),
           (5000000, "5M+"), (None, "Non spécifié")]


def test_amount_bucket_boundaries(spark):
    df = spark.createDataFrame([(a, e) for a, e in AMOUNTS], "a bigint, expected string")
    got = df.select(P.amount_bucket(F.col("a")).alias("b"), "expected").collect()
    assert all(r.b == r.expected for r in got)


def test_zero_amount_is_absent_for_filters_only(spark):
    df = spark.createDataFrame([(0,), (None,), (10,)], "a bigint")
    r = df.select(P.amount_present(F.col("a")).alias("p"), P.amount_bucket(F.col("a")).alias("b")).collect()
    assert [x.p for x in r] == [False, False, True]
    assert r[0].b == "0-25k"


def _tenders(spark, rows):
    return spark.createDataFrame(rows, "tender_id long, ao_type string, sector string, "
                                       "estimated_amount bigint, technical_domains array<string>, "
                                       "organisme string, geographic_scope string, "
                                       "criteria_weights map<string,int>")


def test_formalism_sensitivity_complexity(spark):
    t = _tenders(spark, [
        (1, "MAPA", "État", 10, ["Conseil"], None, None, {"prix": 40, "technique": 60}),
        (2, "Ouvert", "État", 1000000, [], None, None, {}),
        (3, "Restreint", "État", 1000001, ["Conseil", "Développement"], None, None, {"technique": 50}),
        (4, "Concours", "État", None, ["Data/IA"], None, None, None),
        (5, "Ouvert", "État", 5, ["Conseil", "Développement", "Support/Maintenance"], None, None,
         {"prix": 80, "technique": 30}),
    ])
    r = {x.tender_id: x for x in profile_tenders(t).collect()}
    assert [r[i].formalism_level for i in range(1, 6)] == ["Minimum", "Standard", "Maximum", "Maximum", "Standard"]
    assert r[1].price_sensitivity == 0.4 and r[2].price_sensitivity == 0.5
    assert r[3].price_sensitivity == 0.5 and r[4].price_sensitivity == 0.5
    assert [r[i].technical_complexity for i in range(1, 6)] == ["Faible", "Faible", "Moyenne", "Élevée", "Élevée"]
    assert r[5].weights_total == 110 and not r[5].weights_valid
    valid, rejected = split_valid_tenders(profile_tenders(t))
    assert [x.tender_id for x in rejected.collect()] == [5]
    assert valid.count() == 4


def test_keywords_and_context(spark):
    t = _tenders(spark, [(1, "Ouvert", "Territorial", 500000, ["Développement", "Infrastructure/Cloud"],
                          "Métropole de Lyon", "Rhône-Alpes", {"technique": 60, "prix": 40})])
    args = [F.col(c) for c in ("ao_type", "sector", "technical_domains", "estimated_amount",
                               "organisme", "geographic_scope")]
    r = t.select(P.search_keywords(*args).alias("k"), P.search_context(*args).alias("c")).first()
    assert r.k == ["Ouvert", "Territorial", "Développement", "Infrastructure/Cloud", "500k-1M",
                   "Métropole de Lyon", "Rhône-Alpes"]
    assert r.c == ("Appel d'offres Ouvert secteur Territorial - montant 500k-1M - domaines techniques: "
                   "Développement, Infrastructure/Cloud - organisme: Métropole de Lyon - périmètre: Rhône-Alpes")
