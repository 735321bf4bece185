"""Tender profile columns (amount bucket, formalism, price sensitivity,
technical complexity, keywords, search context) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake import schemas as S


def amount_bucket(amount: Column, zero_is_unknown: bool = False) -> Column:
    """Bucket label of an amount; NULL gives "Non spécifié".

    ``zero_is_unknown`` reproduces the truthiness test used by filters and
    query enrichment, where an amount of 0 counts as absent.
    """
    expr = F.when(amount.isNull(), F.lit(S.AMOUNT_UNKNOWN))
    if zero_is_unknown:
        expr = F.when(amount.isNull() | (amount == 0), F.lit(S.AMOUNT_UNKNOWN))
    for bound, label in S.AMOUNT_BUCKETS:
        expr = expr.when(amount < F.lit(bound), F.lit(label)) if bound is not None \
            else expr.otherwise(F.lit(label))
    return expr


def amount_present(amount: Column) -> Column:
    """Truthiness of an amount: NULL and 0 are absent."""
    return amount.isNotNull() & (amount != 0)


def formalism_level(ao_type: Column, amount: Column) -> Column:
    return (F.when(ao_type == "MAPA", F.lit("Minimum"))
            .when(ao_type.isin("Ouvert", "Restreint"),
                  F.when(amount.isNotNull() & (amount > 1000000), F.lit("Maximum"))
                  .otherwise(F.lit("Standard")))
            .otherwise(F.lit("Maximum")))


def price_sensitivity(weights: Column) -> Column:
    """0.5 without weights, else weight of 'prix' (default 50) / 100."""
    w = F.coalesce(weights, F.create_map().cast("map<string,int>"))
    return (F.when(F.size(w) == 0, F.lit(0.5))
            .otherwise(F.coalesce(F.element_at(w, F.lit("prix")), F.lit(50)).cast("double")
                       / F.lit(100.0)))


def technical_complexity(domains: Column) -> Column:
    d = F.coalesce(domains, F.array().cast("array<string>"))
    complex_ = F.array(*[F.lit(x) for x in S.COMPLEX_DOMAINS])
    return (F.when(F.size(d) == 0, F.lit("Faible"))
            .when((F.size(d) >= 3) | F.arrays_overlap(d, complex_), F.lit("Élevée"))
            .when(F.size(d) == 2, F.lit("Moyenne"))
            .otherwise(F.lit("Faible")))


def weights_total(weights: Column) -> Column:
    """Sum of criteria weights (0 for an empty or null map)."""
    w = F.coalesce(weights, F.create_map().cast("map<string,int>"))
    return F.aggregate(F.map_values(w), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + x.cast("bigint"))


def search_keywords(ao_type: Column, sector: Column, domains: Column, amount: Column,
                    organisme: Column, geo: Column) -> Column:
    """type, sector, domains..., bucket (always), organisme?, scope?"""
    d = F.coalesce(domains, F.array().cast("array<string>"))
    opt = lambda c: F.when((c.isNotNull()) & (c != ""), F.array(c)).otherwise(
        F.array().cast("array<string>"))
    return F.concat(F.array(ao_type, sector), d, F.array(amount_bucket(amount)),
                    opt(organisme), opt(geo))


def search_context(ao_type: Column, sector: Column, domains: Column, amount: Column,
                   organisme: Column, geo: Column) -> Column:
    """'Appel d'offres T secteur S - montant R - domaines techniques: a, b - ...'"""
    d = F.coalesce(domains, F.array().cast("array<string>"))
    nonblank = lambda c: c.isNotNull() & (c != "")
    return F.concat_ws(
        " - ",
        F.concat(F.lit("Appel d'offres "), ao_type, F.lit(" secteur "), sector),
        F.when(amount_present(amount), F.concat(F.lit("montant "), amount_bucket(amount))),
        F.when(F.size(d) > 0, F.concat(F.lit("domaines techniques: "), F.array_join(d, ", "))),
        F.when(nonblank(organisme), F.concat(F.lit("organisme: "), organisme)),
        F.when(nonblank(geo), F.concat(F.lit("périmètre: "), geo)),
    )


def enrich_query(query: Column, ctx: Column) -> Column:
    """Query text enriched with the request context (unchanged without one)."""
    d = F.coalesce(ctx["technical_domains"], F.array().cast("array<string>"))
    amt = ctx["estimated_amount"]
    org = ctx["organisme"]
    enriched = F.concat_ws(
        " - ",
        query,
        F.concat(F.lit("appel offres "), ctx["ao_type"]),
        F.concat(F.lit("secteur "), ctx["sector"]),
        F.when(amount_present(amt), F.concat(F.lit("montant "), amount_bucket(amt))),
        F.when(F.size(d) > 0, F.concat(F.lit("technologies "), F.array_join(d, " "))),
        F.when(org.isNotNull() & (org != ""), F.concat(F.lit("organisme "), org)),
    )
    return F.when(ctx.isNull(), query).otherwise(enriched)
