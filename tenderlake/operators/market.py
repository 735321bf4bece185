"""Market analytics over awards (price benchmarks, competitors, templates,
positioning, go/no-go, data confidence, freshness, routing).

``awards``: one row per (tender, supplier) bid with ``price``, ``won``,
segment columns ``sector`` and ``amount_range`` and ``published`` date.
Percentiles are exact and distributed: ranks come from range-partitioned
running counts (no per-group value buffer), interpolation as
``percentile_cont``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators.blocks import checked_broadcast
from tenderlake.operators.running import running_totals

BANDS = [0.1, 0.2, 0.3, 0.5, 0.7, 0.9]


def within_months(date: Column, as_of: Column, months: int) -> Column:
    return date >= F.add_months(as_of, -months)


# ---------------------------------------------------------------- B2
def exact_percentiles(df: DataFrame, by: list[str], value: str, tie: str,
                      probs: list[float] = BANDS) -> DataFrame:
    """Exact linear-interpolated percentiles of ``value`` per ``by`` group
    (same definition as ``percentile_cont``), one column ``p<NN>`` each.

    Ranks come from distributed running counts; one pass keeps the rows at
    the two ranks around each probability (an equi-join against a table of
    groups × probabilities × 2 rows, broadcast after a check of its size).
    """
    df = df.filter(F.col(value).isNotNull())
    ranked = running_totals(df.select(*by, value, tie).withColumn("_one", F.lit(1.0)),
                            by, [value, tie], "_one").select(*by, value, F.col("before_count").alias("_r"))
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    wanted = (n.select(*[F.col(b).alias("_w_" + b) for b in by], "_n", F.explode(ps).alias("_p"))
              .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("_p"))
              .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))))
    wanted = checked_broadcast(wanted)
    on = [ranked[b].eqNullSafe(wanted["_w_" + b]) for b in by] + [ranked["_r"] == wanted["_rank"]]
    lo = F.max(F.when(F.col("_rank") == F.floor("_h"), F.col(value)))
    hi = F.max(F.when(F.col("_rank") == F.ceil("_h"), F.col(value)))
    picked = (ranked.join(wanted, reduce(lambda a, b: a & b, on)).groupBy(*by, "_n", "_p", "_h")
              .agg(lo.alias("_lv"), hi.alias("_hv")))
    picked = picked.withColumn("_v", F.col("_lv") + (F.col("_h") - F.floor("_h")) * (F.col("_hv") - F.col("_lv")))
    return picked.groupBy(*by).agg(
        F.first("_n").alias("n"),
        *[F.round(F.max(F.when(F.col("_p") == p, F.col("_v"))), 6).alias(f"p{int(round(p * 100)):02d}")
          for p in probs])


def price_benchmark(awards: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """B2: winning-price bands per segment over the last ``months``:
    aggressive 10-20, competitive 30-50, premium 70-90 percentiles."""
    w = awards.filter(F.col("won") & within_months(F.col("published"), as_of, months))
    return exact_percentiles(w, ["sector", "amount_range"], "price", "bid_id")


def segment_counts(awards: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """Won awards per segment over the last ``months``: the ``n`` of B2."""
    w = awards.filter(F.col("won") & within_months(F.col("published"), as_of, months) & F.col("price").isNotNull())
    return w.groupBy("sector", "amount_range").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- B4
def likely_competitors(awards: DataFrame, as_of: Column, months: int = 18, top: int = 5) -> DataFrame:
    """Per segment, suppliers by number of bids in the last ``months``
    (dense rank), with mean price and wins; top ``top`` ranks kept."""
    recent = awards.filter(within_months(F.col("published"), as_of, months))
    g = recent.groupBy("sector", "amount_range", "supplier").agg(
        F.count(F.lit(1)).alias("bids"),
        # exact decimal sum, one division: the same double in any engine
        (F.sum(F.col("price").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("_avg"),
        F.count_if("won").alias("wins"))
    w = Window.partitionBy("sector", "amount_range").orderBy(F.col("bids").desc())
    return (g.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= top)
            .select("sector", "amount_range", "supplier", "bids", "wins",
                    F.round("_avg", 6).alias("avg_price"), "rank"))


# ---------------------------------------------------------------- B5 / B8
def template_ranking(usage: DataFrame, min_win_rate: float = 0.3, min_uses: int = 100) -> DataFrame:
    """Templates with win rate > ``min_win_rate`` over at least
    ``min_uses`` uses, ranked by win rate, mean score, mean feedback, name."""
    g = usage.groupBy("template").agg(
        F.count(F.lit(1)).alias("uses"), F.avg(F.col("won").cast("double")).alias("_wr"),
        F.avg("score").alias("_sc"),
        # integer sum, one division: the same double in any engine
        (F.sum("feedback").cast("double") / F.count("feedback")).alias("_fb"))
    ok = g.filter((F.col("_wr") > min_win_rate) & (F.col("uses") >= min_uses))
    w = Window.orderBy(F.col("_wr").desc(), F.col("_sc").desc(), F.col("_fb").desc(), F.col("template"))
    # one row per template: the ranked set is bounded by the template catalogue
    return ok.select("template", "uses", F.round("_wr", 6).alias("win_rate"),
                     F.round("_sc", 6).alias("avg_score"), F.round("_fb", 6).alias("avg_feedback"),
                     F.row_number().over(w).alias("rank"))


def success_weighting(items: DataFrame, usage: DataFrame, score_col: str) -> DataFrame:
    """Multiply a score by the win rate of the item's template."""
    wr = usage.groupBy("template").agg(F.avg(F.col("won").cast("double")).alias("_wr"))
    return (items.join(checked_broadcast(wr), "template", "left")
            .withColumn("weighted_score", F.col(score_col) * F.coalesce(F.col("_wr"), F.lit(0.0)))
            .drop("_wr"))


# ---------------------------------------------------------------- segment stats
def segment_competition(awards: DataFrame) -> DataFrame:
    """Distinct suppliers per segment (partial aggregation then count)."""
    return (awards.select("sector", "amount_range", "supplier").distinct()
            .groupBy("sector", "amount_range").agg(F.count(F.lit(1)).alias("competitors")))


# ---------------------------------------------------------------- B3 / B6
def price_positioning(profiled: DataFrame, competition: DataFrame) -> DataFrame:
    """Aggressive (price weight > 60 and dense competition: segment
    competitors ≥ median over segments), premium (technical weight > 50 and
    high technical complexity), else competitive."""
    # median over the segment table (one row per segment: a bounded domain)
    seg = competition.withColumn("_med", F.percentile("competitors", 0.5).over(Window.partitionBy()))
    t = profiled.join(checked_broadcast(seg), ["sector", "amount_range"], "left")
    w = F.coalesce(F.col("criteria_weights"), F.create_map().cast("map<string,int>"))
    prix = F.coalesce(F.try_element_at(w, F.lit("prix")), F.lit(0))
    tech = F.coalesce(F.try_element_at(w, F.lit("technique")), F.lit(0))
    dense = F.coalesce(F.col("competitors") >= F.col("_med"), F.lit(False))
    pos = (F.when((prix > 60) & dense, F.lit("aggressive"))
           .when((tech > 50) & (F.col("technical_complexity") == "Élevée"), F.lit("premium"))
           .otherwise(F.lit("competitive")))
    return t.select("tender_id", "sector", "amount_range",
                    F.coalesce(F.col("competitors"), F.lit(0)).alias("competitors"),
                    pos.alias("positioning"))


def go_no_go(profiled: DataFrame, competition: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Weighted sum (25/20/20/15/10/10) of six criteria in [0, 1]:
    budget confirmed (amount set), skills fit (complexity not high → 1,
    else 0.5), competition (1 - competitors / max competitors), margin
    (1 - price sensitivity), relationship (buyer known), timeline
    (formalism not maximal → 1, else 0.5)."""
    seg = competition.withColumn("_max", F.max("competitors").over(Window.partitionBy()))
    t = profiled.join(checked_broadcast(seg), ["sector", "amount_range"], "left")
    comp = F.coalesce(F.col("competitors"), F.lit(0)).cast("double")
    crit = {
        "budget_confirme": F.when(F.col("estimated_amount").isNotNull()
                                  & (F.col("estimated_amount") != 0), 1.0).otherwise(0.0),
        "fit_competences": F.when(F.col("technical_complexity") == "Élevée", 0.5).otherwise(1.0),
        "competition_level": F.lit(1.0) - comp / F.greatest(F.coalesce(F.col("_max"), F.lit(1)), F.lit(1)),
        "margin_potential": F.lit(1.0) - F.col("price_sensitivity"),
        "relationship_access": F.when(F.col("organisme").isNotNull() & (F.col("organisme") != ""), 1.0)
        .otherwise(0.0),
        "timeline_realistic": F.when(F.col("formalism_level") == "Maximum", 0.5).otherwise(1.0),
    }
    score = reduce(lambda a, b: a + b, [F.lit(float(wt)) * crit[name] for name, wt in S.GO_NOGO_WEIGHTS])
    return t.select("tender_id", F.round(score, 6).alias("go_score"),
                    F.when(score >= threshold, F.lit("GO")).otherwise(F.lit("NO-GO")).alias("decision"))


# ---------------------------------------------------------------- B7
def recency_boost(results: DataFrame, as_of: Column, months: int = 12, factor: float = 1.5) -> DataFrame:
    """Scores of rows younger than ``months`` × ``factor``, then rerank
    per request."""
    boosted = F.when(within_months(F.col("date_publication"), as_of, months),
                     F.col("relevance_score") * factor).otherwise(F.col("relevance_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("boosted_score").desc(), F.col("rank"))
    return (results.withColumn("boosted_score", boosted)
            .withColumn("boosted_rank", F.row_number().over(w)))


# ---------------------------------------------------------------- B10 / B13 / B14
def data_confidence(counts: DataFrame, n0: float = 10.0, minimum: float = 0.5) -> DataFrame:
    """Confidence n / (n + n0) per segment and whether it reaches ``minimum``."""
    c = F.col("n").cast("double") / (F.col("n") + F.lit(n0))
    return counts.withColumn("confidence", F.round(c, 6)).withColumn("reliable", c >= minimum)


def price_gaps(awards: DataFrame, medians: DataFrame) -> DataFrame:
    """Award price minus the tender estimate, and minus the segment median."""
    med = checked_broadcast(medians.select("sector", "amount_range", F.col("p50").alias("_med")))
    j = awards.filter("won").join(med, ["sector", "amount_range"], "left")
    return j.select("bid_id", "tender_id", "sector", "amount_range",
                    F.round(F.col("price") - F.col("estimated_amount"), 6).alias("gap_to_estimate"),
                    F.round(F.col("price") - F.col("_med"), 6).alias("gap_to_market"),
                    F.round(F.try_divide(F.col("price") - F.col("_med"), F.col("_med")), 6)
                    .alias("gap_to_market_ratio"))


def prediction_gap(pred: DataFrame) -> DataFrame:
    """Mean absolute gap between predicted and actual per segment."""
    gap = F.abs(F.col("predicted") - F.col("actual")).cast("decimal(20,6)")
    g = pred.groupBy("sector", "amount_range").agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap).alias("_s"))
    # exact decimal sum, one division: the same double in any engine
    return g.select("sector", "amount_range", "n",
                    F.round(F.col("_s").cast("double") / F.col("n"), 6).alias("mean_abs_gap"))


def freshness_coverage(corpus: DataFrame, as_of: Column) -> DataFrame:
    """Mean age in days and share of the 36 sector × procedure cells
    that hold at least one document."""
    a = corpus.agg(F.avg(F.datediff(as_of, F.col("date_publication"))).alias("_age"),
                   F.count_distinct("secteur", "type_ao").alias("cells"))
    return a.select(F.round("_age", 6).alias("mean_age_days"), "cells",
                    F.round(F.col("cells") / F.lit(float(len(S.SECTORS) * len(S.AO_TYPES))), 6)
                    .alias("coverage"))


# ---------------------------------------------------------------- B11
def route_requests(requests: DataFrame, text_col: str = "query") -> DataFrame:
    """Mode with the most trigger-word hits (ties: declaration order);
    NULL when no trigger matches.  Triggers are a fixed 4-mode table."""
    q = F.lower(F.col(text_col))
    hits = [F.lit(0)]
    scores = []
    for i, (mode, words) in enumerate(S.MODE_TRIGGERS):
        h = reduce(lambda a, b: a + b, [F.when(F.contains(q, F.lit(w.lower())), 1).otherwise(0)
                                        for w in words])
        scores.append((i, mode, h))
    best = F.greatest(*[h for _, _, h in scores])
    mode = F.lit(None).cast("string")
    for i, m, h in reversed(scores):
        mode = F.when((h == best) & (best > 0), F.lit(m)).otherwise(mode)
    return requests.select("query_id", *[h.alias(f"hits_{m.lower()}") for _, m, h in scores],
                           mode.alias("mode"))


# ---------------------------------------------------------------- B15 / B16
def search_quality(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of results with similarity above ``threshold`` per collection."""
    return results.groupBy("collection").agg(
        F.count(F.lit(1)).alias("results"),
        F.round(F.avg(F.when(F.col("similarity_score") > threshold, 1.0).otherwise(0.0)), 6)
        .alias("relevant_share"))


def precision_recall(results: DataFrame, corpus: DataFrame, judgements: DataFrame) -> DataFrame:
    """Per collection, precision@k (relevant results of the judged ones)
    and recall@k (relevant documents found at least once, of all relevant
    ones).  ``judgements``: (doc_id, relevant), a row a document."""
    judged = results.join(judgements, "doc_id")
    p = judged.groupBy("collection").agg(F.count(F.lit(1)).alias("judged"), F.count_if("relevant").alias("_relevant"))
    # one row a found document first: no distinct set of a collection in one place
    found = judged.filter("relevant").select("collection", "doc_id").distinct().groupBy("collection").agg(F.count(F.lit(1)).alias("_found"))
    wanted = corpus.join(judgements.filter("relevant"), "doc_id").groupBy("collection").agg(F.count(F.lit(1)).alias("_wanted"))
    j = wanted.join(p, "collection", "left").join(found, "collection", "left")
    return j.select("collection", F.coalesce("judged", F.lit(0)).alias("judged"),
                    F.round(F.try_divide(F.col("_relevant").cast("double"), F.col("judged")), 6).alias("precision_at_k"),
                    F.round(F.coalesce("_found", F.lit(0)).cast("double") / F.col("_wanted"), 6).alias("recall_at_k"))


def top_sectors(requests: DataFrame, top: int = 3) -> DataFrame:
    """Requests per sector ranked (dense rank, top ``top``)."""
    g = requests.filter(F.col("ctx").isNotNull()).groupBy(F.col("ctx.sector").alias("sector")) \
        .agg(F.count(F.lit(1)).alias("requests"))
    w = Window.orderBy(F.col("requests").desc())  # one row per sector (6 values)
    return g.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= top)


def requests_per_day(log: DataFrame) -> DataFrame:
    """Search requests per day."""
    return (log.filter(F.col("operation") == "rag_search")
            .groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests")))
