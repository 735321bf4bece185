"""Operation reports over the operation log (``op_log``) and data tables.

All reports are aggregations with map-side partial aggregation; running
means use the distributed prefix sums of ``running``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators.blocks import checked_broadcast
from tenderlake.operators.market import exact_percentiles
from tenderlake.operators.running import running_totals


def _price(model: str) -> float:
    return next((p for m, _, p, _ in S.MODELS if m == model), S.UNKNOWN_MODEL_PRICE)


# ---------------------------------------------------------------- A1 / A3 / A7
def search_stats(log: DataFrame, model: str = S.DEFAULT_MODEL) -> DataFrame:
    """A1 + A7: searches (failures counted), mean duration over successful
    searches, cache hit rate of searches, embedding cost and cost per search."""
    op = F.col("operation")
    is_search = op == "rag_search"
    failed = ~F.col("success")
    a = log.agg(
        F.count_if(is_search).alias("successful_searches"),
        F.count_if(failed).alias("failed_searches"),
        F.avg(F.when(is_search, F.col("duration_ms"))).alias("_avg"),
        F.count_if(is_search & F.col("cache_hit")).alias("_hits"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("_docs"),
    )
    total = F.col("successful_searches") + F.col("failed_searches")
    cost = F.col("_tokens").cast("double") / F.lit(1000.0) * F.lit(_price(model))
    return a.select(
        total.alias("total_searches"), "successful_searches", "failed_searches",
        F.round(F.coalesce(F.col("_avg"), F.lit(0.0)), 6).alias("avg_search_time_ms"),
        F.round(F.try_divide(F.col("_hits").cast("double"), F.col("successful_searches")), 6)
        .alias("cache_hit_rate"),
        F.round(cost, 9).alias("total_cost_usd"),
        F.round(cost / F.greatest(F.lit(1), total), 12).alias("avg_cost_per_search"),
        F.col("_docs").cast("bigint").alias("total_documents_added"),
    )


def embedding_stats(log: DataFrame, model: str = S.DEFAULT_MODEL) -> DataFrame:
    """A3: requests (searches + embedding calls), tokens, cost, cache hits,
    API calls, errors, mean call latency, hit rate = hits / requests."""
    op = F.col("operation")
    req = op.isin("rag_search", "embedding_call")
    a = log.agg(
        F.count_if(req).alias("total_requests"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.count_if(F.coalesce(F.col("cache_hit"), F.lit(False))).alias("cache_hits"),
        F.count_if(op == "embedding_call").alias("api_calls"),
        F.count_if(~F.col("success")).alias("errors"),
        F.avg(F.when(op == "embedding_call", F.col("duration_ms"))).alias("_lat"),
    )
    return a.select(
        "total_requests", "total_tokens",
        F.round(F.floor(F.col("total_tokens").cast("double")) / F.lit(1000.0) * F.lit(_price(model)), 9)
        .alias("total_cost_usd"),
        "cache_hits", "api_calls", "errors",
        F.round(F.coalesce(F.col("_lat"), F.lit(0.0)), 6).alias("avg_latency_ms"),
        F.round(F.try_divide(F.col("cache_hits").cast("double"), F.col("total_requests")), 6)
        .alias("cache_hit_rate"))


def docs_per_collection(log: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents added per registered collection with a max(1, n) guard.
    Log rows and collection rows are unioned and aggregated in one pass."""
    u = log.select(F.col("documents").cast("bigint").alias("_d"), F.lit(0).alias("_c")) \
        .unionByName(collections.select(F.lit(None).cast("bigint").alias("_d"), F.lit(1).alias("_c")))
    a = u.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("docs"), F.sum("_c").alias("n"))
    return a.select(F.col("docs").cast("bigint").alias("total_documents_added"),
                    F.col("n").cast("bigint").alias("collections"),
                    F.round(F.col("docs") / F.greatest(F.lit(1), F.col("n")), 6)
                    .alias("docs_per_collection"))


# ---------------------------------------------------------------- A4 / F17
def cost_by_model(log: DataFrame, models: DataFrame) -> DataFrame:
    """A4 + F17: tokens per model, truncated once on the total, × price;
    unknown models take the default dimension and price.  ``models`` is the
    3-row model dimension (broadcast; fixed size)."""
    g = (log.filter(F.col("operation") == "embedding_call")
         .groupBy("model").agg(F.count(F.lit(1)).alias("calls"),
                               F.sum(F.col("tokens").cast("double")).alias("_tok")))
    m = models.select(F.col("model").alias("_m"), "dimension", "price_per_1k")
    j = g.join(F.broadcast(m), g.model == m._m, "left")
    tokens = F.floor(F.col("_tok")).cast("bigint")
    price = F.coalesce(F.col("price_per_1k"), F.lit(S.UNKNOWN_MODEL_PRICE))
    return j.select("model", "calls", tokens.alias("tokens"),
                    F.coalesce(F.col("dimension"), F.lit(S.UNKNOWN_MODEL_DIM)).alias("dimension"),
                    F.round(tokens.cast("double") / F.lit(1000.0) * price, 9).alias("cost_usd"))


# ---------------------------------------------------------------- A8 / S13
def error_triage(log: DataFrame) -> DataFrame:
    """Error rows classified by status code, counted per class."""
    st = F.col("status_code")
    e = log.filter(~F.col("success"))
    return e.groupBy("status_code").agg(F.count(F.lit(1)).alias("errors")).select(
        "status_code", "errors",
        ((st >= S.RETRYABLE_STATUS_MIN) | (st == S.STATUS_RATE_LIMITED)).alias("is_retryable"),
        st.isin(*S.STATUS_AUTH).alias("is_authentication_error"),
        (st == S.STATUS_RATE_LIMITED).alias("is_rate_limited"),
        F.when(st.isin(*S.STATUS_AUTH), F.lit("API_AUTH_ERROR"))
        .when(st == S.STATUS_RATE_LIMITED, F.lit("API_RATE_LIMIT"))
        .when(st >= 500, F.lit("API_SERVER_ERROR"))
        .otherwise(F.lit("API_CLIENT_ERROR")).alias("error_class"))


def error_records(errors: DataFrame) -> DataFrame:
    """One row per failed operation: type, code, status, masked context,
    correlation id."""
    e = classify_errors(errors)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "error_type", "error_code", "status_code",
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("correlation_id"),
                    mask_map(F.col("context")).alias("context"))


def classify_errors(errors: DataFrame) -> DataFrame:
    """A8 + S13: (kind, code, config_key, status_code, ...) rows with their
    ``error_type``, ``error_code`` and one flag a class.  Provider codes are
    mapped to classes; unknown ones are ``API_UNKNOWN``."""
    kind, code, st = F.col("kind"), F.col("code"), F.col("status_code")
    api = kind == "api"
    known = F.create_map(*[F.lit(x) for pair in S.PROVIDER_ERROR_CODES for x in pair])
    types = F.create_map(*[F.lit(x) for x in ("api", "APIError", "cache", "CacheError", "config", "ConfigurationError",
                                              "vector_store", "VectorStoreError")])
    error_code = F.when(api, F.coalesce(F.try_element_at(known, code), F.lit("API_UNKNOWN"))).otherwise(code)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return errors.withColumns({
        "error_type": F.coalesce(F.try_element_at(types, kind), F.lit("Error")),
        "error_code": error_code,
        "is_retryable": flag(api & ((st >= S.RETRYABLE_STATUS_MIN) | (st == S.STATUS_RATE_LIMITED))),
        "is_quota_exceeded": flag(api & (code == "insufficient_quota")),
        "is_context_too_long": flag(api & (code == "context_length_exceeded")),
        "is_recoverable": flag((kind == "cache") & code.isin(S.RECOVERABLE_CACHE_CODES)),
        "is_authentication_config": flag((kind == "config") & F.lower("config_key").rlike("|".join(S.AUTH_CONFIG_WORDS))),
        "is_connection_error": flag((kind == "vector_store") & (code == "CONNECTION_FAILED")),
        "is_collection_error": flag((kind == "vector_store") & (code == "COLLECTION_NOT_FOUND")),
    })


ERROR_FLAGS = ["is_retryable", "is_quota_exceeded", "is_context_too_long", "is_recoverable", "is_authentication_config",
               "is_connection_error", "is_collection_error"]


def error_classes(classified: DataFrame) -> DataFrame:
    """Classified errors per kind, code and flags."""
    return classified.groupBy("kind", "error_code", *ERROR_FLAGS).agg(F.count(F.lit(1)).alias("errors"))


# ---------------------------------------------------------------- A9 / W4
def operation_metrics(log: DataFrame) -> DataFrame:
    """Per operation count, success count, mean / p50 / p95 duration
    (exact percentiles by distributed ranks: no buffer of an operation's values)."""
    d = F.col("duration_ms")
    counts = log.groupBy("operation").agg(
        F.count(F.lit(1)).alias("operations"),
        F.count_if(F.col("success")).alias("successes"),
        F.round(F.avg(d), 6).alias("avg_duration_ms"),
        F.round(F.max(d), 2).alias("max_duration_ms"))
    p = exact_percentiles(log, ["operation"], "duration_ms", "event_id", [0.5, 0.95]).select(
        F.col("operation").alias("_op"), "p50", "p95")
    j = counts.join(checked_broadcast(p), counts["operation"].eqNullSafe(p["_op"]), "left")
    return j.select("operation", "operations", "successes", "avg_duration_ms", F.col("p50").alias("p50_duration_ms"),
                    F.col("p95").alias("p95_duration_ms"), "max_duration_ms")


def running_mean_duration(log: DataFrame) -> DataFrame:
    """Running mean of duration per operation in event order.

    Durations are kept to 2 decimals, so sums run on integer hundredths
    (exact in any order) and the mean is one division at the end."""
    cents = F.round(F.col("duration_ms") * 100.0).cast("bigint")
    base = log.select("event_id", "ts", "operation", cents.alias("_cents"))
    r = running_totals(base, ["operation"], ["ts", "event_id"], "_cents")
    mean = (F.col("before_sum") + F.col("_cents")) / ((F.col("before_count") + 1) * F.lit(100.0))
    return r.select("event_id", "operation", F.round(mean, 6).alias("running_avg_ms"),
                    (F.col("before_count") + 1).alias("n"))


# ---------------------------------------------------------------- A10
def health_report(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """A10: one row per component (healthy iff its predicate holds on its
    one-row aggregate) plus ``overall`` = all components healthy."""
    rows = [df.select(F.lit(name).alias("component"), pred.alias("healthy"))
            for name, df, pred in checks]
    comps = reduce(lambda a, b: a.unionByName(b), rows)
    overall = comps.agg(F.bool_and("healthy").alias("healthy")).select(
        F.lit("overall").alias("component"), "healthy")
    return comps.unionByName(overall).select(
        "component", F.when(F.col("healthy"), F.lit("healthy")).otherwise(F.lit("unhealthy"))
        .alias("status"))


# ---------------------------------------------------------------- F15
def mask_map(m: Column, keys: list[str] = S.SENSITIVE_KEYS) -> Column:
    """values of sensitive keys (substring of the lower-cased key) are
    masked: strings longer than 8 keep first 4 and last 4, else ``***``."""
    ks = F.array(*[F.lit(k) for k in keys])
    keep = S.MASK_KEEP

    def mask(k, v):
        sensitive = F.exists(ks, lambda s: F.contains(F.lower(k), s))
        masked = F.when(F.length(v) > S.MASK_MIN_LEN,
                        F.concat(F.substring(v, 1, keep), F.lit("..."),
                                 F.substring(v, -keep, keep))).otherwise(F.lit("***"))
        return F.when(sensitive, masked).otherwise(v)

    return F.transform_values(m, mask)


# ---------------------------------------------------------------- A2
def per_search_summary(requests: DataFrame, results: DataFrame, n_filters: Column) -> DataFrame:
    """A2: results count and mean similarity (0.0 when none) per request."""
    # exact decimal sum and one division: the same double in any engine
    g = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results_count"),
        (F.sum(F.col("similarity_score").cast("decimal(18,6)")).cast("double")
         / F.count(F.lit(1))).alias("_avg"))
    return (requests.select("query_id", n_filters.alias("filters_applied"))
            .join(g, "query_id", "left")
            .select("query_id", F.coalesce(F.col("results_count"), F.lit(0)).alias("results_count"),
                    F.round(F.coalesce(F.col("_avg"), F.lit(0.0)), 6).alias("avg_similarity"),
                    "filters_applied"))


def operations_rollup(log: DataFrame) -> DataFrame:
    """Operations, successes and tokens by operation, model and day, with the
    subtotals of each and the total; ``level`` tells them apart (bits of the
    columns summed over: 0 none, 1 days, 3 models too, 7 all)."""
    rows = log.select("operation", "model", F.date_format("ts", "yyyy-MM-dd").alias("day"), "success", "tokens")
    return rows.rollup("operation", "model", "day").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("operations"), F.count_if("success").alias("successes"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
