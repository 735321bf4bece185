"""Domain views derived by Spark from the driver tables.

``corpus``   documents with tender metadata (orders, customer, nation, region)
``tenders``  one tender per order with context fields and technical domains
``*_queries`` search requests built from whole tables
``op_log``   operation log rows mapped from ``events``

All joins are equi-joins on keys; the only fixed-size dimensions (nation 25
rows, region 5 rows) are broadcast, everything else is left to the planner
and AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.profile import amount_bucket
from tenderlake.functions.vectors import hashed_tf
from tenderlake.sources.tables import read_table, spread

# Collection of a fixture document by doc_id % 5.
FIXTURE_COLLECTIONS = ["historique_ao", "reglementaire", "references_clients",
                       "templates_performants", "intelligence_concurrentielle"]
# Buyer kind of a customer by c_custkey % 6.
FIXTURE_ORG_KINDS = ["Région", "Département", "Ministère", "CHU", "Université", "Ville"]
# Amount factor by o_orderkey % 5.
FIXTURE_AMOUNT_FACTORS = [0.1, 0.5, 1.0, 4.0, 20.0]
AS_OF_DATE = "2001-08-01"


def _pick(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _order_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region with the tender metadata columns."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    k = F.col("o_orderkey")
    c = F.col("c_custkey")
    montant = F.floor(F.col("o_totalprice") * _pick(FIXTURE_AMOUNT_FACTORS, F.pmod(k, F.lit(5)))) \
        .cast("bigint")
    sector = (F.when(F.pmod(c, F.lit(6)) <= 1, F.lit("Territorial"))
              .when(F.pmod(c, F.lit(6)) == 2, F.lit("État"))
              .when(F.pmod(c, F.lit(6)) == 3, F.lit("Hospitalier"))
              .when(F.pmod(c, F.lit(6)) == 4, F.lit("Éducation"))
              .when(F.pmod(k, F.lit(2)) == 0, F.lit("EPA/EPIC"))
              .otherwise(F.lit("Défense")))
    return (orders
            .join(cust, orders.o_custkey == cust.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                k.alias("o_orderkey"),
                F.concat(_pick(FIXTURE_ORG_KINDS, F.pmod(c, F.lit(6))), F.lit(" "),
                         F.col("n_name")).alias("organisme"),
                _pick(S.AO_TYPES, F.pmod(k, F.lit(6))).alias("type_ao"),
                sector.alias("secteur"),
                montant.alias("montant_int"),
                F.col("o_orderdate").cast("date").alias("date_publication"),
                F.col("r_name").alias("zone_geo"),
            ))


def corpus(spark: SparkSession, sf_dir: str, embedding: str = "hashed_tf",
           n_buckets: int = 64) -> DataFrame:
    """Documents with tender metadata and an embedding column.

    ``embedding``: ``hashed_tf`` (computed from text, 64 dims), ``precomputed``
    (the ``embeddings`` table joined by ``vec_id = doc_id``; documents without
    a vector are dropped) or ``none``.
    """
    return corpus_from(spark, sf_dir, read_table(spark, sf_dir, "documents"), embedding, n_buckets)


def corpus_from(spark: SparkSession, sf_dir: str, documents: DataFrame, embedding: str = "hashed_tf",
                n_buckets: int = 64) -> DataFrame:
    """``corpus`` over any documents frame (a table or a stream)."""
    docs = documents.select("doc_id", "text")
    meta = _order_meta(spark, sf_dir)
    df = docs.join(meta, docs.doc_id == meta.o_orderkey)
    d = F.col("doc_id")
    df = df.select(
        d.alias("doc_id"),
        collection_of(d).alias("collection"),
        F.col("text").alias("content"),
        "secteur", "type_ao",
        amount_bucket(F.col("montant_int")).alias("fourchette_montant"),
        _pick(S.DOMAINS, F.pmod(d, F.lit(7))).alias("domaine_technique"),
        "organisme",
        F.col("montant_int").cast("double").alias("montant"),
        "date_publication", "zone_geo",
    )
    if embedding == "hashed_tf":
        if not df.isStreaming:
            df = spread(df, documents, "doc_id")
        df = df.withColumn("embedding", hashed_tf(F.col("content"), n_buckets))
    elif embedding == "precomputed":
        emb = read_table(spark, sf_dir, "embeddings").select(
            F.col("vec_id"), F.col("embedding"))
        df = df.join(emb, df.doc_id == emb.vec_id).drop("vec_id")
    elif embedding != "none":
        raise ValueError(f"unknown embedding {embedding!r}")
    return df


def collection_of(doc_id: Column) -> Column:
    """Collection of a fixture document."""
    return _pick(FIXTURE_COLLECTIONS, F.pmod(doc_id, F.lit(5)))


def corpus_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of every row of metadata that ``corpus`` joins its documents with."""
    return _order_meta(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"))


def tender_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct technical domains of each order's line items, in domain order.

    ``collect_set`` holds at most 7 values per order, so the group is bounded.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    g = (li.groupBy("l_orderkey")
         .agg(F.array_sort(F.collect_set(F.pmod(F.col("l_partkey"), F.lit(7)).cast("int")))
              .alias("idx")))
    names = F.array(*[F.lit(x) for x in S.DOMAINS])
    return g.select(F.col("l_orderkey"),
                    F.transform("idx", lambda i: F.element_at(names, i + 1))
                    .alias("technical_domains"))


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tender per order with the 12 context fields."""
    meta = _order_meta(spark, sf_dir)
    meta = spread(meta, read_table(spark, sf_dir, "orders"), "o_orderkey")
    k = F.col("o_orderkey")
    dom = tender_domains(spark, sf_dir)
    df = meta.join(dom, meta.o_orderkey == dom.l_orderkey, "left")
    prix = F.lit(30) + F.pmod(k, F.lit(41)).cast("int")
    technique = F.when(F.pmod(k, F.lit(25)) == 1, F.lit(100)) \
        .otherwise(F.lit(70) - F.pmod(k, F.lit(41)).cast("int"))
    weights = F.when(F.pmod(k, F.lit(10)) == 0, F.create_map().cast("map<string,int>")) \
        .otherwise(F.create_map(F.lit("prix"), prix.cast("int"),
                                F.lit("technique"), technique.cast("int")))
    return df.select(
        k.alias("tender_id"),
        F.col("type_ao").alias("ao_type"),
        F.col("secteur").alias("sector"),
        F.when(F.pmod(k, F.lit(13)) == 0, F.lit(None).cast("bigint"))
        .when(F.pmod(k, F.lit(17)) == 0, F.lit(0).cast("bigint"))
        .otherwise(F.col("montant_int")).alias("estimated_amount"),
        F.coalesce(F.col("technical_domains"), F.array().cast("array<string>"))
        .alias("technical_domains"),
        F.when(F.pmod(k, F.lit(9)) == 0, F.lit(None).cast("string"))
        .otherwise(F.col("organisme")).alias("organisme"),
        F.col("zone_geo").alias("geographic_scope"),
        F.col("date_publication").alias("published"),
        weights.alias("criteria_weights"),
    )


def context_of(ao_type: Column, sector: Column, amount: Column, domains: Column,
               organisme: Column) -> Column:
    return F.struct(ao_type.alias("ao_type"), sector.alias("sector"),
                    amount.cast("bigint").alias("estimated_amount"),
                    domains.alias("technical_domains"), organisme.alias("organisme"))


def document_queries(spark: SparkSession, sf_dir: str, limit: int = S.DEFAULT_LIMIT,
                     min_similarity: float = S.DEFAULT_MIN_SIMILARITY) -> DataFrame:
    """Every document searches its own collection with its own row as context."""
    c = corpus(spark, sf_dir, embedding="none")
    c = spread(c, read_table(spark, sf_dir, "documents"), "doc_id")
    return c.select(
        F.col("doc_id").alias("query_id"),
        F.col("content").alias("query"),
        "collection",
        F.lit(limit).alias("limit"),
        F.lit(float(min_similarity)).alias("min_similarity"),
        context_of(F.col("type_ao"), F.col("secteur"), F.col("montant"),
                   F.array(F.col("domaine_technique")), F.col("organisme")).alias("ctx"),
    )


def conversation_queries(spark: SparkSession, sf_dir: str, collection: str = S.DEFAULT_COLLECTION,
                         limit: int = S.DEFAULT_LIMIT,
                         min_similarity: float = S.DEFAULT_MIN_SIMILARITY) -> DataFrame:
    """Every user turn of ``conversations`` as a free-text request, no context."""
    raw = read_table(spark, sf_dir, "conversations")
    conv = spread(raw.select("conv_id", "turn", "role", "text"), raw, "conv_id")
    return conv.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
        F.lit(collection).alias("collection"),
        F.lit(limit).alias("limit"),
        F.lit(float(min_similarity)).alias("min_similarity"),
        F.lit(None).cast(S.CONTEXT_TYPE).alias("ctx"),
    )


def tender_queries(spark: SparkSession, sf_dir: str, limit: int = S.DEFAULT_LIMIT,
                   min_similarity: float = S.DEFAULT_MIN_SIMILARITY) -> DataFrame:
    """Every tender searches the history collection with its search-context text."""
    from tenderlake.functions.profile import search_context
    t = tenders(spark, sf_dir)
    return t.select(
        F.col("tender_id").alias("query_id"),
        search_context(F.col("ao_type"), F.col("sector"), F.col("technical_domains"),
                       F.col("estimated_amount"), F.col("organisme"),
                       F.col("geographic_scope")).alias("query"),
        F.lit(S.DEFAULT_COLLECTION).alias("collection"),
        F.lit(limit).alias("limit"),
        F.lit(float(min_similarity)).alias("min_similarity"),
        context_of(F.col("ao_type"), F.col("sector"), F.col("estimated_amount"),
                   F.col("technical_domains"), F.col("organisme")).alias("ctx"),
    )


# Model of an embedding call by user_id % 4 (the last name is not a known model).
LOG_MODELS = ["text-embedding-3-large", "text-embedding-3-small", "text-embedding-ada-002",
              "custom-embedder"]


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation log mapped from ``events`` (ts cast to TIMESTAMP, UTC).

    view → search (cache hit), click → search (cache miss), purchase →
    embedding call (tokens = props.k), signup → documents added (count =
    props.k), error → failed operation with status from props.k % 6.
    """
    return op_log_from(read_table(spark, sf_dir, "events"))


def op_log_from(events: DataFrame) -> DataFrame:
    """``op_log`` over any events frame (a table or a stream)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    et = F.col("event_type")
    status = _pick([401, 403, 404, 429, 500, 503], F.pmod(k, F.lit(6)))
    op = (F.when(et.isin("view", "click"), F.lit("rag_search"))
          .when(et == "purchase", F.lit("embedding_call"))
          .when(et == "signup", F.lit("add_documents"))
          .otherwise(F.lit("failed_operation")))
    return ev.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"),
        et.alias("event_type"),
        op.alias("operation"),
        F.col("value").alias("duration_ms"),
        (et != "error").alias("success"),
        F.when(et == "view", F.lit(True)).when(et == "click", F.lit(False)).alias("cache_hit"),
        F.when(et == "purchase", k).alias("tokens"),
        F.when(et == "signup", k).alias("documents"),
        F.when(et == "error", status.cast("int")).alias("status_code"),
        k.alias("k"),
        _pick(LOG_MODELS, F.pmod(F.col("user_id"), F.lit(4))).alias("model"),
        F.create_map(F.lit("user"), F.concat(F.lit("user_"), F.col("user_id").cast("string")),
                     F.lit("session_token"), F.md5(F.col("event_id").cast("string")),
                     F.lit("auth_level"), k.cast("string"),
                     F.lit("event"), et).alias("context"),
    )


# Error of a failed operation by k % 12: where it arose, its code, and the
# configuration key it names.
ERROR_KINDS = ["api", "api", "api", "api", "api", "api", "cache", "cache", "config", "config", "vector_store", "vector_store"]
ERROR_CODES = ["insufficient_quota", "rate_limit_exceeded", "invalid_api_key", "model_not_found", "context_length_exceeded", "",
               "CACHE_CORRUPTED_DATA", "CACHE_WRITE_FAILED", "CONFIG_MISSING", "CONFIG_INVALID", "CONNECTION_FAILED", "COLLECTION_NOT_FOUND"]
ERROR_CONFIG_KEYS = ["", "", "", "", "", "", "", "", "PROVIDER_API_KEY", "log_level", "", ""]


def typed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed operations with the kind, code and configuration key of their error."""
    log = op_log(spark, sf_dir).filter(~F.col("success"))
    case = F.pmod("k", F.lit(12))
    none = F.lit(None).cast("string")
    return log.select("event_id", "ts", "user_id", "status_code", "context", _pick(ERROR_KINDS, case).alias("kind"),
                      F.coalesce(F.nullif(_pick(ERROR_CODES, case), F.lit("")), none).alias("code"),
                      F.coalesce(F.nullif(_pick(ERROR_CONFIG_KEYS, case), F.lit("")), none).alias("config_key"))


# ---------------------------------------------------------------- cache fixture
CACHE_MODEL = "hashed-tf-64"
CACHE_EPOCH = "2024-01-01 00:00:00"
CACHE_AS_OF = "2024-01-02 12:00:00"
CACHE_CUTOFF = "1998-01-01"   # documents published before were embedded by an earlier run


def cache_table(spark: SparkSession, sf_dir: str, cutoff: str | None = CACHE_CUTOFF) -> DataFrame:
    """Embedding cache left by an earlier run: one entry per document
    published before ``cutoff`` (with none: per document); ``cached_at`` spread
    over two days; one entry in 50 carries a wrong text hash (corruption)."""
    from tenderlake.functions.text import cache_key, key_prefix
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs
    if cutoff is not None:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate") \
            .filter(F.col("o_orderdate") < F.lit(cutoff).cast("timestamp"))
        d = docs.join(orders, docs.doc_id == orders.o_orderkey).select("doc_id", "text")
    d = spread(d, docs, "doc_id")
    t = F.col("text")
    emb = hashed_tf(t, 64)
    corrupt = F.pmod(F.col("doc_id"), F.lit(50)) == 7
    return d.select(
        cache_key(t, F.lit(CACHE_MODEL)).alias("cache_key"), t.alias("text"),
        F.lit(CACHE_MODEL).alias("model"), emb.alias("embedding"),
        F.when(corrupt, F.md5(F.concat(t, F.lit(" ")))).otherwise(F.md5(t)).alias("text_hash"),
        F.lit(64).alias("embedding_dimension"),
        (F.lit(CACHE_EPOCH).cast("timestamp")
         + F.make_interval(mins=F.pmod(F.col("doc_id"), F.lit(2880)).cast("int"))).alias("cached_at"),
        (F.lit(4 * 64) + F.octet_length(t)).cast("bigint").alias("size_bytes"),
    ).withColumn("key_prefix", key_prefix(F.col("cache_key")))


def text_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to embed: every document, ``pos`` = doc_id."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, docs, "doc_id").select(F.col("doc_id").alias("pos"), "text")


# ---------------------------------------------------------------- ingestion fixture
INGEST_TS = "2024-03-01 09:00:00"


def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as add-documents calls: one batch per (source, collection),
    ``pos`` = rank of the document inside its batch by doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    return batches_from(spread(docs, docs, "doc_id"))


def batches_from(documents: DataFrame) -> DataFrame:
    """``document_batches`` over any documents frame (a table or a stream)."""
    docs = documents.select("doc_id", "text", "source", "lang")
    coll = _pick(FIXTURE_COLLECTIONS, F.pmod(F.col("doc_id"), F.lit(5)))
    return docs.select(
        F.concat_ws("/", F.col("source"), coll).alias("batch_id"),
        coll.alias("collection"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("source_doc"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("collection"), F.lit("user")).alias("extra"),
    )


def benchmark_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as one call into a new collection."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.select(F.lit("benchmark").alias("batch_id"), F.lit("benchmark").alias("collection"),
                    F.col("text").alias("content"), F.col("item_id").alias("source_doc"))


# ---------------------------------------------------------------- market fixture
def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bid per (order, supplier): price = sum of discounted line prices
    (exact decimal sum), won when any line is not returned; segment from the
    tender (sector, amount bucket), ``published`` = order date."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    dec = "decimal(15,2)"
    line = F.col("l_extendedprice").cast(dec) * (F.lit(1).cast(dec) - F.col("l_discount").cast(dec))
    bids = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(line).cast("double").alias("price"),
        F.bool_or(F.col("l_returnflag") != "R").alias("won"))
    t = tenders(spark, sf_dir).select("tender_id", "sector", "estimated_amount", "published")
    j = bids.join(t, bids.l_orderkey == t.tender_id)
    return j.select(
        (F.col("l_orderkey") * F.lit(1000000) + F.col("l_suppkey")).alias("bid_id"),
        "tender_id", F.col("l_suppkey").alias("supplier"), "price", "won", "sector",
        amount_bucket(F.col("estimated_amount")).alias("amount_range"), "estimated_amount", "published")


def template_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template (part brand) uses: one per line item; won when not returned,
    score = quantity / 50, feedback 1 to 5 by line number."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select(F.col("p_brand").alias("template"), (F.col("l_returnflag") != "R").alias("won"),
                    (F.col("l_quantity") / F.lit(50.0)).alias("score"), "l_partkey",
                    (F.pmod("l_linenumber", F.lit(5)) + 1).cast("bigint").alias("feedback"))
