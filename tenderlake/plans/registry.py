"""Registered queries: name → (Spark job, DuckDB oracle SQL or None).

Each Spark job takes ``(spark, sf_dir)`` and returns a DataFrame whose
computed columns carry the same names as the oracle's.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tenderlake.functions.text import cache_key as _ck, key_prefix as _kp
from tenderlake.operators import cache as C
from tenderlake.operators import ingest as IG
from tenderlake.operators import reports as RP
from tenderlake.operators import market as MK
from tenderlake.streaming import streams as ST
from tenderlake.operators.search import (applied_filters, display_summary, knn_candidates, prepare_requests, rerank,
                                         result_columns, validate_requests)
from tenderlake.functions.text import word_count as _wc
from tenderlake.operators import profile as PR
from tenderlake.operators.providers import HashedTF, Precomputed
from tenderlake.operators.search import SearchOptions, search
from tenderlake.plans import oracle as O
from tenderlake.operators.blocks import checked_broadcast
from tenderlake.session import ensure_checkpoint_dir, scratch_path, written
from tenderlake.sources import fixtures as fx
from tenderlake.sources.tables import spread

Job = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Job, str | None]] = {}


def prepare_session(spark: SparkSession) -> None:
    """Results are defined in UTC; the checkpoint folder comes from the
    cluster (``spark.checkpoint.dir``) and is only set here when missing."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def register(name: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)
        job.__name__, job.__doc__ = fn.__name__, fn.__doc__
        REGISTRY[name] = (job, sql)
        return fn
    return deco


# ------------------------------------------------------------------ search
@register("search_documents", O.search_sql(O.DOC_REQUESTS, "l2sq"))
def search_documents(spark, sf_dir):
    """Flagship: every document searches its collection with its own context."""
    return search(fx.document_queries(spark, sf_dir), fx.corpus(spark, sf_dir))


@register("search_conversations", O.search_sql(O.CONV_REQUESTS, "cosine"))
def search_conversations(spark, sf_dir):
    """Free-text user turns, no context, cosine metric, default collection."""
    return search(fx.conversation_queries(spark, sf_dir), fx.corpus(spark, sf_dir),
                  opts=SearchOptions(metric="cosine"))


# ------------------------------------------------------------------ tender profile
@register("f6_f9_profile_tenders", O.PROFILE)
def profile_tenders_q(spark, sf_dir):
    """Derived tender columns."""
    p = PR.profile_tenders(fx.tenders(spark, sf_dir))
    return p.select("tender_id", "ao_type", "sector", "estimated_amount", "organisme",
                    "geographic_scope", "amount_range", "formalism_level",
                    F.round("price_sensitivity", 6).alias("price_sensitivity"),
                    "technical_complexity", "weights_total", "weights_valid",
                    F.array_join("technical_domains", "|").alias("domains"))


@register("p9_reject_tenders", O.TENDER_REJECTS)
def reject_tenders_q(spark, sf_dir):
    """Tenders whose criteria weights sum above 100 (quarantine)."""
    _, rejected = PR.split_valid_tenders(PR.profile_tenders(fx.tenders(spark, sf_dir)))
    return rejected.select("tender_id", "weights_total", "reject_reason")


@register("f10_f11_keywords_context", O.KEYWORDS)
def keywords_q(spark, sf_dir):
    """F10 search keywords and F11 search-context text of every tender."""
    k = PR.keywords_and_context(fx.tenders(spark, sf_dir))
    return k.select("tender_id", F.array_join("search_keywords", " | ").alias("search_keywords"),
                    "search_context")


# ------------------------------------------------------------------ embedding cache
M3_MAX_BYTES = 500_000   # test parameter: small enough that every scale factor evicts


def _as_of():
    return F.lit(fx.CACHE_AS_OF).cast("timestamp")


def _probed(spark, sf_dir):
    texts = fx.text_batch(spark, sf_dir)
    valid = texts.filter(~C.is_blank(F.col("text")))
    return C.probe(valid, fx.cache_table(spark, sf_dir), fx.CACHE_MODEL, _as_of())


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@register("f12_cache_key", O.F12_KEYS)
def cache_key_q(spark, sf_dir):
    """cache key, key prefix and raw-text hash of every document."""
    docs = fx.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = spread(docs, docs, "doc_id")
    k = _ck(F.col("text"), F.lit(fx.CACHE_MODEL))
    return d.select("doc_id", k.alias("cache_key"), _kp(k).alias("key_prefix"),
                    F.md5("text").alias("text_hash"))


@register("j2_cache_probe", O.J2_PROBE)
def cache_probe_q(spark, sf_dir):
    """J2 + F13 + F14: hit / corrupt / miss per text."""
    return _probed(spark, sf_dir).select("pos", "cache_key", "status")


@register("j3_cache_misses", O.J3_MISSES)
def cache_misses_q(spark, sf_dir):
    """Distinct keys to embed."""
    return C.misses(_probed(spark, sf_dir)).select("cache_key")


@register("m6_corrupt_keys", O.M6_CORRUPT)
def corrupt_q(spark, sf_dir):
    """M6: keys whose fresh entry fails the integrity check."""
    return C.corrupt_keys(_probed(spark, sf_dir))


@register("e1_embed_with_cache", O.E1_EMBED)
def embed_cache_q(spark, sf_dir):
    """E1 + J4: vectors for every text, from the cache or the provider."""
    out, _ = C.embed_with_cache(fx.text_batch(spark, sf_dir), fx.cache_table(spark, sf_dir),
                                HashedTF(64), _as_of())
    return out.select("pos", "status", "from_cache",
                      F.size("embedding").cast("int").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0),
                                          lambda a, x: a + x.cast("double")), 6).alias("vsum"))


@register("m1_upsert", O.M1_UPSERT)
def upsert_q(spark, sf_dir):
    """M1: cache after writing the entries of the misses (last write wins)."""
    cache = fx.cache_table(spark, sf_dir)
    _, new = C.embed_with_cache(fx.text_batch(spark, sf_dir), cache, HashedTF(64), _as_of())
    return C.upsert(cache, new).select("cache_key", _ts(F.col("cached_at")).alias("cached_at"),
                                       "size_bytes", "text_hash")


@register("m2_expire", O.M2_EXPIRE)
def expire_q(spark, sf_dir):
    """M2: entries still valid at as_of."""
    return C.expire(fx.cache_table(spark, sf_dir, cutoff=None), _as_of()).select(
        "cache_key", _ts(F.col("cached_at")).alias("cached_at"), "size_bytes")


@register("m3_evict", O.m3_evict_sql(M3_MAX_BYTES))
def evict_q(spark, sf_dir):
    """M3: oldest-first eviction down to 80 % of the size limit."""
    return C.evict_oldest(fx.cache_table(spark, sf_dir, cutoff=None), M3_MAX_BYTES).select(
        "cache_key", "size_bytes", "evicted")


@register("a5_cache_stats", O.A5_STATS)
def cache_stats_q(spark, sf_dir):
    """A5 + A6 + M4: hit rate, savings and size."""
    return C.cache_stats(_probed(spark, sf_dir), fx.cache_table(spark, sf_dir))


@register("m5_clear_report", O.M5_CLEAR)
def clear_q(spark, sf_dir):
    """M5: entries and bytes a clear removes."""
    return C.clear_report(fx.cache_table(spark, sf_dir, cutoff=None))


# ------------------------------------------------------------------ ingestion
def _ingest_ts():
    return F.lit(fx.INGEST_TS).cast("timestamp")


def _all_batches(spark, sf_dir):
    return fx.document_batches(spark, sf_dir).unionByName(
        fx.benchmark_batches(spark, sf_dir), allowMissingColumns=True)


def _ingested(spark, sf_dir):
    docs = IG.with_submission_time(_all_batches(spark, sf_dir), _ingest_ts(), "source_doc")
    rows, _ = IG.ingest(docs, None, F.col("submitted_at"), order_col="source_doc")
    return rows


@register("s2_ingest_documents", O.S2_INGEST)
def ingest_q(spark, sf_dir):
    """S2 + S4 + S5: accepted rows with generated ids and forced metadata."""
    r = _ingested(spark, sf_dir)
    return r.select("doc_id", "collection", "batch_id", "document_length", "engine_version",
                    _ts(F.col("added_at")).alias("added_at"),
                    F.try_element_at("extra", F.lit("lang")).alias("lang"),
                    F.try_element_at("extra", F.lit("collection")).alias("meta_collection"))


@register("s3_batch_validation", O.S3_VERDICT)
def batch_validation_q(spark, sf_dir):
    """S3: per-batch verdict (any blank document rejects the batch)."""
    return IG.batch_verdicts(_all_batches(spark, sf_dir))


@register("s7_ingest_summary", O.S7_SUMMARY)
def ingest_summary_q(spark, sf_dir):
    """S7 + A4: documents, characters, tokens and cost per batch."""
    good, _ = IG.validate_batches(_all_batches(spark, sf_dir))
    return IG.ingest_summary(good, "text-embedding-3-large")


@register("s1_register_collections", O.S1_COLLECTIONS)
def collections_q(spark, sf_dir):
    """Default collections plus every new name seen in the batches."""
    return IG.register_collections(IG.default_collections(spark), _all_batches(spark, sf_dir))


@register("s9_collection_counts", O.S9_COUNTS)
def collection_counts_q(spark, sf_dir):
    """Documents per registered collection (0 when empty)."""
    reg = IG.register_collections(IG.default_collections(spark), _all_batches(spark, sf_dir))
    good, _ = IG.validate_batches(_all_batches(spark, sf_dir))
    return IG.collection_counts(reg, good)


# ------------------------------------------------------------------ reports over the operation log
@register("a1_search_stats", O.A1_STATS)
def search_stats_q(spark, sf_dir):
    """A1 + A7: search totals (failures counted), mean time, hit rate, cost per search."""
    return RP.search_stats(fx.op_log(spark, sf_dir), "text-embedding-3-large")


@register("a3_embedding_stats", O.A3_STATS)
def embedding_stats_q(spark, sf_dir):
    """A3: embedding-service counters and hit rate."""
    return RP.embedding_stats(fx.op_log(spark, sf_dir), "text-embedding-3-large")


@register("a4_cost_by_model", O.A4_COST)
def cost_by_model_q(spark, sf_dir):
    """A4 + F17: tokens and cost per model through the 3-row model dimension."""
    return RP.cost_by_model(fx.op_log(spark, sf_dir), IG.price_table(spark))


@register("a7_docs_per_collection", O.A7_RATIO)
def docs_per_collection_q(spark, sf_dir):
    """Documents added per registered collection, max(1, n) guard."""
    return RP.docs_per_collection(fx.op_log(spark, sf_dir), IG.default_collections(spark))


@register("a8_error_triage", O.A8_TRIAGE)
def error_triage_q(spark, sf_dir):
    """Errors per status with retryable / auth / rate-limit classes."""
    return RP.error_triage(fx.op_log(spark, sf_dir))


@register("s13_error_records", O.S13_ERRORS)
def error_records_q(spark, sf_dir):
    """Failed operations as error rows."""
    e = RP.error_records(fx.typed_errors(spark, sf_dir))
    return e.select("event_id", "timestamp", "error_type", "error_code", "status_code", "correlation_id",
                    F.col("context")["session_token"].alias("session_token"))


@register("a9_operation_metrics", O.A9_METRICS)
def operation_metrics_q(spark, sf_dir):
    """Per-operation count, successes, mean and percentile durations."""
    return RP.operation_metrics(fx.op_log(spark, sf_dir))


@register("w4_running_mean", O.W4_RUNNING)
def running_mean_q(spark, sf_dir):
    """Running mean duration per operation (distributed prefix sums)."""
    return RP.running_mean_duration(fx.op_log(spark, sf_dir))


@register("s12_op_log", O.S12_LOG)
def op_log_q(spark, sf_dir):
    """The operation log as typed rows."""
    lg = fx.op_log(spark, sf_dir)
    return lg.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                     "operation", "duration_ms", "success", "status_code", "tokens", "documents",
                     "cache_hit")


@register("f15_mask_context", O.F15_MASK)
def mask_q(spark, sf_dir):
    """sensitive keys of the log context masked."""
    m = RP.mask_map(F.col("context"))
    lg = fx.op_log(spark, sf_dir).select("event_id", m.alias("m"))
    return lg.select("event_id", *[F.col("m")[k].alias(k) for k in
                                   ("user", "session_token", "auth_level", "event")])


@register("f16_token_estimate", O.F16_TOKENS)
def token_estimate_q(spark, sf_dir):
    """F16 + P12: words, token estimate (words x 1.3) and token-limit flag."""
    d = fx.read_table(spark, sf_dir, "documents")
    w = _wc(F.col("text"))
    est = w.cast("double") * F.lit(1.3)
    return d.select("doc_id", w.cast("int").alias("words"), F.round(est, 6).alias("token_estimate"),
                    (est > 8191).alias("over_token_limit"))


@register("a10_health", O.A10_HEALTH)
def health_q(spark, sf_dir):
    """A10: data health per component and overall."""
    docs = fx.read_table(spark, sf_dir, "documents")
    emb = fx.read_table(spark, sf_dir, "embeddings")
    lg = fx.op_log(spark, sf_dir)
    checks = [
        ("documents", docs.agg((F.count(F.lit(1)) > 0)
                               & (F.count_if(C.is_blank(F.col("text"))) == 0)).toDF("h"), F.col("h")),
        ("embeddings", emb.agg((F.count(F.lit(1)) > 0)
                               & F.bool_and(F.size("embedding") == 64)).toDF("h"), F.col("h")),
        ("op_log_latency", lg.agg(F.coalesce(F.avg("duration_ms"), F.lit(0.0)) < 500.0).toDF("h"),
         F.col("h")),
        ("op_log_error_rate", lg.agg((F.count_if(~F.col("success")).cast("double")
                                      / F.greatest(F.lit(1), F.count(F.lit(1)))) <= 0.05).toDF("h"),
         F.col("h")),
    ]
    return RP.health_report(checks)


# ------------------------------------------------------------------ market analytics
def _mk_as_of():
    return F.lit(fx.AS_OF_DATE).cast("date")


def _profiled(spark, sf_dir):
    return PR.profile_tenders(fx.tenders(spark, sf_dir))


@register("b1_similar_tenders", O.B1_SIMILAR)
def similar_tenders_q(spark, sf_dir):
    """B1: every tender's similar history documents of the last 24 months."""
    corp = fx.corpus(spark, sf_dir).filter(MK.within_months(F.col("date_publication"), _mk_as_of(), 24))
    return search(fx.tender_queries(spark, sf_dir), corp)


@register("b2_price_benchmark", O.B2_BENCH)
def price_benchmark_q(spark, sf_dir):
    """B2: winning-price percentile bands per segment, last 12 months (exact)."""
    return MK.price_benchmark(fx.awards(spark, sf_dir), _mk_as_of())


@register("b3_price_positioning", O.B3_POSITION)
def positioning_q(spark, sf_dir):
    """Aggressive / competitive / premium per tender."""
    return MK.price_positioning(_profiled(spark, sf_dir),
                                MK.segment_competition(fx.awards(spark, sf_dir)))


@register("b4_likely_competitors", O.B4_COMPETITORS)
def competitors_q(spark, sf_dir):
    """Top suppliers per segment over the last 18 months."""
    return MK.likely_competitors(fx.awards(spark, sf_dir), _mk_as_of())


@register("b5_template_ranking", O.B5_TEMPLATES)
def templates_q(spark, sf_dir):
    """Templates with win rate > 30 % over at least 100 uses."""
    return MK.template_ranking(fx.template_usage(spark, sf_dir))


@register("b6_go_no_go", O.B6_GONOGO)
def go_no_go_q(spark, sf_dir):
    """Weighted go/no-go score per tender."""
    return MK.go_no_go(_profiled(spark, sf_dir), MK.segment_competition(fx.awards(spark, sf_dir)))


@register("b7_recency_boost", O.B7_RECENCY)
def recency_q(spark, sf_dir):
    """Results younger than 12 months boosted ×1.5, then reranked."""
    good, _ = prepare_requests(fx.document_queries(spark, sf_dir), HashedTF())
    cands = knn_candidates(good, fx.corpus(spark, sf_dir), 64, SearchOptions(carry=["date_publication"]))
    r = rerank(cands)
    res = r.select("query_id", "doc_id", "rank", "relevance_score", "date_publication")
    out = MK.recency_boost(res, _mk_as_of())
    return out.select("query_id", "doc_id", "rank", F.round("boosted_score", 6).alias("boosted_score"),
                      "boosted_rank")


@register("b8_success_weighting", O.B8_WEIGHTING)
def success_weighting_q(spark, sf_dir):
    """Part price weighted by its template's win rate."""
    part = fx.read_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("template"), "p_retailprice")
    w = MK.success_weighting(part, fx.template_usage(spark, sf_dir), "p_retailprice")
    return w.select("p_partkey", "template", F.round("weighted_score", 6).alias("weighted_score"))


@register("b10_data_confidence", O.B10_CONFIDENCE)
def confidence_q(spark, sf_dir):
    """Confidence n / (n + 10) of each segment's benchmark."""
    return MK.data_confidence(MK.segment_counts(fx.awards(spark, sf_dir), _mk_as_of()))


@register("b11_route_requests", O.B11_ROUTE)
def route_q(spark, sf_dir):
    """Mode of each user request by trigger-word hits."""
    return MK.route_requests(fx.conversation_queries(spark, sf_dir))


@register("b12_price_gaps", O.B12_GAPS)
def price_gaps_q(spark, sf_dir):
    """Won price vs estimate and vs segment median."""
    aw = written(fx.awards(spark, sf_dir), "awards")
    return MK.price_gaps(aw, MK.price_benchmark(aw, _mk_as_of()))


@register("b13_prediction_gap", O.B13_PREDICTION)
def prediction_gap_q(spark, sf_dir):
    """Segment median as prediction vs actual won prices."""
    aw = written(fx.awards(spark, sf_dir), "awards")
    bench = checked_broadcast(MK.price_benchmark(aw, _mk_as_of()).select("sector", "amount_range", F.col("p50")))
    recent = aw.filter(F.col("won") & MK.within_months(F.col("published"), _mk_as_of(), 12))
    pred = recent.join(bench, ["sector", "amount_range"]).select(
        "sector", "amount_range", F.col("p50").alias("predicted"), F.col("price").alias("actual"))
    return MK.prediction_gap(pred)


@register("b14_freshness_coverage", O.B14_FRESHNESS)
def freshness_q(spark, sf_dir):
    """Mean document age and sector × procedure coverage."""
    return MK.freshness_coverage(fx.corpus(spark, sf_dir, embedding="none"), _mk_as_of())


@register("b15_search_quality", O.B15_QUALITY)
def search_quality_q(spark, sf_dir):
    """Share of results with similarity above 0.7 per collection."""
    return MK.search_quality(search(fx.document_queries(spark, sf_dir), fx.corpus(spark, sf_dir)))


@register("b16_top_sectors", O.B16_TOP_SECTORS)
def top_sectors_q(spark, sf_dir):
    """Most requested sectors (tender requests)."""
    return MK.top_sectors(fx.tender_queries(spark, sf_dir))


@register("b16_requests_per_day", O.B16_PER_DAY)
def per_day_q(spark, sf_dir):
    """Search requests per day."""
    return MK.requests_per_day(fx.op_log(spark, sf_dir))


@register("b17_cross_collection", O.B17_CROSS)
def cross_collection_q(spark, sf_dir):
    """Every document linked to its nearest documents in every other collection."""
    from tenderlake.operators.search import search_vectors
    # a document's vector is both sides': computed once, then it asks every other collection
    corp = written(fx.corpus(spark, sf_dir), "cross-corpus")
    names = F.array(*[F.lit(c) for c in fx.FIXTURE_COLLECTIONS])
    req = (corp.filter(~C.is_blank(F.col("content")))
           .select("doc_id", F.col("embedding").alias("q_vec"), F.col("collection").alias("_own"), F.posexplode(names).alias("_i", "collection"))
           .filter(F.col("collection") != F.col("_own"))
           .select((F.col("doc_id") * 10 + F.col("_i")).alias("query_id"), "q_vec", "collection", F.lit(5).alias("limit"),
                   F.lit(0.5).alias("min_similarity"), F.lit(None).cast(fx.S.CONTEXT_TYPE).alias("ctx")))
    return search_vectors(req, corp.drop("content"), 64, SearchOptions(stored=True))


# ------------------------------------------------------------------ search building blocks
def _conv_param_requests(spark, sf_dir):
    c = fx.read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                    F.col("text").alias("query"), F.col("turn").cast("int").alias("limit"),
                    (F.pmod(F.col("conv_id"), F.lit(13)) / F.lit(10.0)).alias("min_similarity"))


@register("p1_validate_requests", O.P1_VALIDATE)
def validate_q(spark, sf_dir):
    """Reject reason per request (parameters taken from each user turn)."""
    return validate_requests(_conv_param_requests(spark, sf_dir)).select("query_id", "reject_reason")


@register("p3_enrich_query", O.P3_ENRICH)
def enrich_q(spark, sf_dir):
    """Request text enriched with the tender context."""
    from tenderlake.functions.profile import enrich_query
    q = fx.tender_queries(spark, sf_dir)
    return q.select("query_id", enrich_query(F.col("query"), F.col("ctx")).alias("enriched_query"))


@register("j1_w1_knn_candidates", O.J1_CANDIDATES)
def candidates_q(spark, sf_dir):
    """J1 + F1 + P6 + W1: the 2·limit nearest candidates per request."""
    good, _ = prepare_requests(fx.document_queries(spark, sf_dir), HashedTF())
    c = knn_candidates(good, fx.corpus(spark, sf_dir), 64)
    return c.select("query_id", "doc_id", "cand_rank", F.round("similarity", 6).alias("similarity"),
                    F.round("distance", 6).alias("distance"))


OVERRIDE_FILTERS = {"type_ao": {"$in": ["MAPA", "Ouvert", "Restreint"]},
                    "fourchette_montant": {"$ne": "5M+"}}


@register("p4_p5_user_filter_override", O.P4_OVERRIDE)
def override_q(spark, sf_dir):
    """P4 + P5 + F2 + W2: user filters replace the context's type and amount
    keys, so the type / amount bonuses vary across results."""
    return search(fx.document_queries(spark, sf_dir), fx.corpus(spark, sf_dir),
                  opts=SearchOptions(filters=OVERRIDE_FILTERS))


@register("f5_display_summary", O.F5_DISPLAY)
def display_q(spark, sf_dir):
    """three-line display text of every result."""
    good, _ = prepare_requests(fx.document_queries(spark, sf_dir), HashedTF())
    corp = fx.corpus(spark, sf_dir)
    r = rerank(knn_candidates(good, corp, 64))
    docs = fx.corpus(spark, sf_dir, embedding="none").select(
        F.col("doc_id").alias("_d"), F.col("content"), F.col("montant"))
    j = r.join(docs, r.doc_id == docs._d)
    return j.select("query_id", "rank", "doc_id",
                    display_summary(F.col("similarity"), F.col("type_ao"), F.col("organisme"),
                                    F.col("montant"), F.col("content")).alias("display_summary"))


@register("a2_per_search_summary", O.A2_SUMMARY)
def per_search_q(spark, sf_dir):
    """A2: results count, mean similarity (0 when none), filters applied."""
    req = fx.document_queries(spark, sf_dir)
    res = search(req, fx.corpus(spark, sf_dir))
    return RP.per_search_summary(req, res, applied_filters(F.col("ctx")))


# ------------------------------------------------------------------ streaming (availableNow runs)
@register("t1_stream_ingest", O.T1_INGEST)
def stream_ingest_q(spark, sf_dir):
    """Documents streamed into the collection table: staged per micro-batch,
    then committed under a manifest; a second commit finds nothing to add."""
    import uuid
    from tenderlake.session import scratch_path
    docs = fx.batches_from(ST.table_stream(spark, sf_dir, "documents"))
    path = ST.stream_ingest(spark, docs, HashedTF())
    table = scratch_path(spark, f"collections-{uuid.uuid4().hex}")
    for _ in range(2):
        ST.commit_staged(spark, path, table, fx.INGEST_TS)
    r = ST.read_committed(spark, table)
    return r.select("doc_id", "collection", "batch_id", "document_length", "engine_version",
                    _ts(F.col("added_at")).alias("added_at"),
                    F.try_element_at("extra", F.lit("lang")).alias("lang"),
                    F.try_element_at("extra", F.lit("collection")).alias("meta_collection"))


@register("t2_stream_dedup", O.T2_DEDUP)
def stream_dedup_q(spark, sf_dir):
    """Repeats of a text within 24 h of its last kept event are dropped."""
    return ST.run_dedup(spark, sf_dir, fx.CACHE_MODEL).select("doc_id", "cache_key")


@register("t3_stream_kpi", O.T3_KPI)
def stream_kpi_q(spark, sf_dir):
    """Daily KPI windows with alert flags, streamed from events."""
    return ST.run_kpi(spark, sf_dir)


@register("t4_stream_alerts", O.T4_ALERTS)
def stream_alerts_q(spark, sf_dir):
    """T4: streamed documents × saved searches (user turns), cosine 0.8 or more."""
    out = ST.run_alerts(spark, sf_dir, fx.conversation_queries(spark, sf_dir, min_similarity=0.8))
    return out.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@register("t5_sessions", O.T5_SESSIONS)
def sessions_q(spark, sf_dir):
    """T5: streamed search sessions per user (30-minute gap), open ones closed at the end."""
    return ST.run_sessions(spark, sf_dir)


# ------------------------------------------------------------------ approximate join
@register("j6_approx_knn", O.J6_APPROX)
def approx_knn_q(spark, sf_dir):
    """LSH candidates (exactly re-scored) for every document request."""
    from tenderlake.operators.ann import approx_candidates
    good, _ = prepare_requests(fx.document_queries(spark, sf_dir), HashedTF())
    return approx_candidates(good, fx.corpus(spark, sf_dir), 64, k=10).select(
        "query_id", "doc_id", "rank", F.round("similarity", 6).alias("similarity"))


@register("j6_recall", O.J6_RECALL)
def approx_recall_q(spark, sf_dir):
    """Recall of the LSH join against the exact candidates (l2sq ≤ 0.5)."""
    from tenderlake.operators.ann import approx_candidates, recall_at_k
    good, _ = prepare_requests(fx.document_queries(spark, sf_dir), HashedTF())
    good = good.withColumn("ctx", F.lit(None).cast(fx.S.CONTEXT_TYPE))  # LSH ignores context
    corp = fx.corpus(spark, sf_dir)
    exact = knn_candidates(good, corp, 64, SearchOptions(kernel="block"))
    return recall_at_k(approx_candidates(good, corp, 64, k=10), exact)


@register("j6_index_recall", O.J6_INDEX_RECALL)
def index_recall_q(spark, sf_dir):
    """A stored index of coarse cells and codes over all documents, searched
    by every document request, against the exact candidates (recall 0.95 or more)."""
    from tenderlake.operators.ann import recall_at_k
    from tenderlake.operators.ivf import build_index
    from tenderlake.operators.providers import ArrowProvider, hashed_tf_numpy
    model = ArrowProvider(hashed_tf_numpy, 64, "hashed-tf-64-numpy")
    good, _ = prepare_requests(fx.document_queries(spark, sf_dir), model)
    good = written(good.select("query_id", "collection", "limit", "min_similarity", "q_vec")
                   .withColumn("ctx", F.lit(None).cast(fx.S.CONTEXT_TYPE)), "ivf-request-vectors")
    docs = fx.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = model.embed(spread(docs, docs, "doc_id"), "text").drop("text")
    # the join with the metadata moves vectors, not texts
    corp = fx.corpus_from(spark, sf_dir, vectors.withColumnRenamed("embedding", "text"), embedding="none")
    corp = written(corp.withColumnRenamed("content", "embedding"), "ivf-corpus-vectors")
    index = build_index(corp, scratch_path(spark, f"ivf-{uuid.uuid4().hex}"), 64, stored=True)
    exact = knn_candidates(good, corp, 64, SearchOptions(kernel="block", stored=True))
    r = recall_at_k(index.search(good, k=10), exact)
    n = index.rows.agg(F.count(F.lit(1)).alias("indexed"))
    return r.join(F.broadcast(n)).select("indexed", "exact_pairs", (F.coalesce(F.col("recall"), F.lit(1.0)) >= 0.95).alias("recall_reached"))


# ------------------------------------------------------------------ checks and user providers
@register("e2_arrow_provider", O.E2_ARROW)
def arrow_provider_q(spark, sf_dir):
    """E2 + E3: a user model over Arrow batches of 100 texts (here the numpy
    form of the hashed TF vectors), run by Spark tasks."""
    from tenderlake.operators.providers import ArrowProvider, hashed_tf_numpy
    docs = fx.text_batch(spark, sf_dir)
    out = ArrowProvider(hashed_tf_numpy, 64, "hashed-tf-64-numpy", batch_rows=100).embed(docs, "text")
    return out.select("pos", F.size("embedding").cast("int").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0),
                                          lambda a, x: a + x.cast("double")), 6).alias("vsum"))


@register("p11_dimension_check", O.P11_DIMENSION)
def dimension_q(spark, sf_dir):
    """Stored vectors whose dimension differs from the model's."""
    e = fx.read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size("embedding").cast("int").alias("dimension"),
                    (F.size("embedding") != 64).alias("dimension_mismatch"))


@register("p13_entry_size_cap", O.P13_OVERSIZE)
def oversize_q(spark, sf_dir):
    """Cache entries above the 10 MB per-entry cap."""
    d = fx.read_table(spark, sf_dir, "documents").select("text")
    e = C.make_entries(d.withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)),
                       fx.CACHE_MODEL, _as_of())
    return e.select("cache_key", "size_bytes",
                    (F.col("size_bytes") > fx.S.CACHE_ENTRY_MAX_BYTES).alias("oversize"))


@register("p7_score_domain", O.P7_SCORES)
def score_domain_q(spark, sf_dir):
    """Results outside [0, 1] (similarity or relevance)."""
    r = search(fx.document_queries(spark, sf_dir), fx.corpus(spark, sf_dir))
    bad = ((F.col("similarity_score") < 0) | (F.col("similarity_score") > 1)
           | (F.col("relevance_score") < 0) | (F.col("relevance_score") > 1))
    return r.agg(F.count(F.lit(1)).alias("results"), F.count_if(bad).alias("out_of_domain"))


# ------------------------------------------------------------------ hybrid search
@register("b9_hybrid_search", O.B9_HYBRID)
def hybrid_q(spark, sf_dir):
    """BM25 top 10 and vector top 10 (cosine) fused by reciprocal rank (k = 60), top 5.
    The corpus is indexed in two batches; then its vectors stay and its texts go."""
    import uuid
    from tenderlake.operators.hybrid import reciprocal_rank_fusion
    from tenderlake.operators.inverted import append_index, bm25_search, read_index
    from tenderlake.session import scratch_path
    req = fx.conversation_queries(spark, sf_dir, min_similarity=0.0)
    texts, path = (scratch_path(spark, f"{x}-{uuid.uuid4().hex}") for x in ("hybrid-texts", "bm25"))
    fx.corpus(spark, sf_dir).drop("montant", "date_publication", "zone_geo").write.option("compression", "zstd").parquet(texts)
    corp = spark.read.parquet(texts)
    for part in (0, 1):
        append_index(corp.filter(F.pmod("doc_id", F.lit(2)) == part), path)
    corp = written(corp.drop("content"), "hybrid-corpus")
    ST.drop_path(spark, texts)
    bm = bm25_search(req, read_index(spark, path), 10)
    good, _ = prepare_requests(req, HashedTF())
    vec = knn_candidates(good, corp, 64, SearchOptions(metric="cosine", stored=True))
    return reciprocal_rank_fusion(bm, vec, 5)


# ------------------------------------------------------------------ sinks
@register("s6_s8_append_read_collection", O.S6_S8_APPEND_READ)
def append_read_q(spark, sf_dir):
    """S6 + S8: append the ingested rows (partitioned by collection), append
    the same ids again (first write wins: nothing new is written), then read
    one collection back (partition pruning)."""
    import uuid
    from tenderlake.session import scratch_path
    path = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    rows = _ingested(spark, sf_dir).select("doc_id", "collection", "document_length")
    IG.append_to_corpus(rows, path)
    again = IG.dedupe_against(rows, spark.read.parquet(path))
    IG.append_to_corpus(again, path)
    return IG.read_collection(spark, path, "historique_ao").select("doc_id", "collection",
                                                                   "document_length")


@register("p2_blank_texts", O.P2_BLANK)
def blank_texts_q(spark, sf_dir):
    """A conversation (one embedding call) with any blank text is rejected."""
    c = fx.read_table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("texts"),
                                    (F.count_if(C.is_blank(F.col("text"))) > 0).alias("rejected"))


@register("s10_export_results", "WITH res AS (" + O.search_sql(O.DOC_REQUESTS, "l2sq") + """)
SELECT to_json({'query_id': query_id, 'rank': rank, 'doc_id': doc_id, 'collection': collection, 'similarity_score': similarity_score,
  'relevance_score': relevance_score, 'ao_type': ao_type, 'sector': sector, 'amount_range': amount_range, 'organisme': organisme,
  'confidence_level': confidence_level, 'is_highly_relevant': is_highly_relevant})::VARCHAR AS json FROM res""")
def export_q(spark, sf_dir):
    """Search results as JSON documents (written to the shared folder)."""
    import uuid
    from tenderlake.operators.search import export_results
    from tenderlake.session import scratch_path
    res = search(fx.document_queries(spark, sf_dir), fx.corpus(spark, sf_dir))
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    export_results(res, path)
    return spark.read.text(path).withColumnRenamed("value", "json")


# ------------------------------------------------------------------ precomputed vectors
@register("e3_precomputed_vector_search", O.VEC_SEARCH)
def vector_search_q(spark, sf_dir):
    """E3 (precomputed provider): every stored vector searches its document's
    collection (cosine, min similarity 0) among documents with stored vectors."""
    from tenderlake.operators.search import search_vectors
    corp = fx.corpus(spark, sf_dir, embedding="precomputed")
    stored = Precomputed(fx.read_table(spark, sf_dir, "embeddings"), "vec_id")
    docs = fx.corpus(spark, sf_dir, embedding="none").select(
        F.col("doc_id").alias("query_id"), "collection", F.lit(5).alias("limit"), F.lit(0.0).alias("min_similarity"))
    req = stored.embed(docs, "", "q_vec", id_col="query_id")
    return search_vectors(req, corp, 64, SearchOptions(metric="cosine"))


from tenderlake.plans import more  # noqa: E402,F401  (registers further queries)
