"""Tender profiling job (amount bucket, formalism, price sensitivity,
technical complexity, keywords, search context, weight check).

All columns are row-local expressions: the job is a single narrow stage
over the tenders table, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import profile as P


def fill_defaults(tenders: DataFrame) -> DataFrame:
    """Null list/map fields become empty (domains, weights, certifications)."""
    out = tenders
    if "technical_domains" in out.columns:
        out = out.withColumn("technical_domains", F.coalesce(
            F.col("technical_domains"), F.array().cast("array<string>")))
    if "criteria_weights" in out.columns:
        out = out.withColumn("criteria_weights", F.coalesce(
            F.col("criteria_weights"), F.create_map().cast("map<string,int>")))
    if "mandatory_certifications" in out.columns:
        out = out.withColumn("mandatory_certifications", F.coalesce(
            F.col("mandatory_certifications"), F.array().cast("array<string>")))
    return out


def profile_tenders(tenders: DataFrame) -> DataFrame:
    """Add the derived profile columns and the weight check.

    ``weights_valid`` is false when the criteria weights sum above 100;
    such rows belong in quarantine (``split_valid_tenders``).
    """
    t = fill_defaults(tenders)
    a, ty, d = F.col("estimated_amount"), F.col("ao_type"), F.col("technical_domains")
    return t.select(
        "*",
        P.amount_bucket(a).alias("amount_range"),
        P.formalism_level(ty, a).alias("formalism_level"),
        P.price_sensitivity(F.col("criteria_weights")).alias("price_sensitivity"),
        P.technical_complexity(d).alias("technical_complexity"),
        P.weights_total(F.col("criteria_weights")).alias("weights_total"),
    ).withColumn("weights_valid", F.col("weights_total") <= 100)


def keywords_and_context(tenders: DataFrame) -> DataFrame:
    t = fill_defaults(tenders)
    args = (F.col("ao_type"), F.col("sector"), F.col("technical_domains"),
            F.col("estimated_amount"), F.col("organisme"), F.col("geographic_scope"))
    return t.select(
        "tender_id",
        P.search_keywords(*args).alias("search_keywords"),
        P.search_context(*args).alias("search_context"),
    )


def split_valid_tenders(profiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the criteria-weight rule."""
    return (profiled.filter(F.col("weights_valid")),
            profiled.filter(~F.col("weights_valid"))
            .withColumn("reject_reason", F.lit("CRITERIA_WEIGHTS_OVER_100")))


def export_tenders(profiled: DataFrame, path: str) -> None:
    """Profiled tenders as JSON lines (all columns, lists and maps nested)."""
    profiled.write.mode("overwrite").json(path)
