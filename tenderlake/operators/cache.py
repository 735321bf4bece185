"""Embedding cache as a table, and the cache-aware embedding job.

The cache is a parquet table partitioned by ``key_prefix`` (first two hex
characters of the key) holding ``cache_key, text, model, embedding,
text_hash, embedding_dimension, cached_at, size_bytes``.  Upserts append a
new version; readers keep the newest version per key (``latest_entries``);
compaction rewrites.

Probe semantics (per text and model):
  hit      key present, entry younger than the TTL at ``as_of`` (strict),
           md5(raw text) equals the stored hash, vector non-empty
  corrupt  key present and fresh but the integrity check fails (counted as
           a miss; dropped at the next compaction)
  miss     everything else
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.text import cache_key, is_blank, key_prefix, word_count
from tenderlake.operators.providers import Provider
from tenderlake.session import written


# ---------------------------------------------------------------- F12-F14
def ttl_valid(cached_at: Column, as_of: Column, ttl_hours: int = S.CACHE_TTL_HOURS) -> Column:
    """``as_of < cached_at + ttl`` (strict)."""
    return as_of < cached_at + F.make_interval(hours=F.lit(ttl_hours))


def content_hash(text: Column, normalize_hash: bool = False) -> Column:
    """md5 of the raw text, or of the text with white space collapsed (as the
    cache key collapses it)."""
    return F.md5(F.trim(F.regexp_replace(text, r"\s+", " ")) if normalize_hash else text)


def integrity_ok(text: Column, model: Column, e_model: Column, e_hash: Column,
                 e_embedding: Column, normalize_hash: bool = False) -> Column:
    """model equal, content hash equal, vector present and non-empty."""
    return (F.coalesce(e_model == model, F.lit(False))
            & F.coalesce(content_hash(text, normalize_hash) == e_hash, F.lit(False))
            & e_embedding.isNotNull() & (F.size(e_embedding) > 0))


def entry_size(text: Column, embedding: Column) -> Column:
    """Stored size of an entry: 4 bytes per component plus the text."""
    return (F.lit(4) * F.size(embedding) + F.octet_length(text)).cast("bigint")


def make_entries(texts: DataFrame, model: str, cached_at: Column,
                 text_col: str = "text", vec_col: str = "embedding", normalize_hash: bool = False,
                 key_col: str | None = None) -> DataFrame:
    """Cache rows for ``texts`` that already carry vectors (M1 input), and, in
    ``key_col``, their cache keys if these are known."""
    t = F.col(text_col)
    return texts.select(
        (F.col(key_col) if key_col else cache_key(t, F.lit(model))).alias("cache_key"),
        t.alias("text"), F.lit(model).alias("model"),
        F.col(vec_col).alias("embedding"), content_hash(t, normalize_hash).alias("text_hash"),
        F.size(F.col(vec_col)).cast("int").alias("embedding_dimension"),
        cached_at.alias("cached_at"),
        entry_size(t, F.col(vec_col)).alias("size_bytes"),
    ).withColumn("key_prefix", key_prefix(F.col("cache_key")))


# ---------------------------------------------------------------- M1
def latest_entries(cache: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Newest version per key (last write wins; equal times: larger hash): an
    aggregate, so that the versions of a hot key combine in their tasks.

    Versions above ``max_bytes`` do not count.  They are left out inside the
    aggregate: a filter would be moved below the columns it reads, and the
    vectors, whose size it takes, would be computed twice."""
    rest = [c for c in cache.columns if c != "cache_key"]
    entry, order = F.struct(*rest), F.struct("cached_at", "text_hash")
    if max_bytes is not None:
        fits = F.col("size_bytes") <= max_bytes
        entry, order = F.when(fits, entry), F.when(fits, order)
    newest = cache.groupBy("cache_key").agg(F.max_by(entry, order).alias("_e"))
    if max_bytes is not None:
        newest = newest.filter(F.col("_e").isNotNull())
    return newest.select("cache_key", "_e.*").select(*cache.columns)


def upsert(cache: DataFrame, new_entries: DataFrame) -> DataFrame:
    """M1: entries after writing ``new_entries`` (same key overwritten).

    Entries above the 10 MB size cap (P13) are not written.
    """
    ok = new_entries.filter(F.col("size_bytes") <= S.CACHE_ENTRY_MAX_BYTES)
    return latest_entries(cache.unionByName(ok))


def write_cache(entries: DataFrame, path: str, mode: str = "append") -> None:
    entries.write.mode(mode).partitionBy("key_prefix").parquet(path)


# ---------------------------------------------------------------- bucketed table
CACHE_SCHEMA = ("cache_key string, text string, model string, embedding array<float>, text_hash string, "
                "embedding_dimension int, cached_at timestamp, size_bytes bigint, key_prefix string")
_BUCKETS = "cache_buckets"


def open_bucketed_cache(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Name of the bucketed cache table at ``path``, declared in this session's
    catalog (the files stay when the session ends; the number of buckets is a
    property of the table, stored beside it).

    Entries are bucketed and sorted by ``cache_key``, so finding the newest
    version of a key and probing it need no exchange of the cache, and row
    groups of other prefixes are skipped by their statistics.  A new table gets
    ``buckets`` or as many as there are shuffle partitions (with fewer Spark
    would shuffle both sides for parallelism).
    """
    path = path.rstrip("/")
    name = f"tenderlake_cache_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    if spark.catalog.tableExists(name):
        return name
    meta = f"{path}/{_BUCKETS}"
    try:
        n = spark.read.schema("buckets int").json(meta).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.json(meta)
    spark.sql(f"CREATE TABLE {name} ({CACHE_SCHEMA}) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) "
              f"INTO {n} BUCKETS LOCATION '{path}/entries'")
    return name


def append_bucketed(entries: DataFrame, table: str) -> None:
    """M1: append the newest version of each key of ``entries`` (those over the
    size cap are not written).  The versions of a hot key combine in their
    tasks before rows go to their bucket; an append adds at most a file a bucket."""
    spark = entries.sparkSession
    n = int(spark.sql(f"DESCRIBE EXTENDED {table}").filter(F.col("col_name") == "Num Buckets").first()["data_type"])
    cols = spark.table(table).columns
    ok = latest_entries(entries.select(*cols), S.CACHE_ENTRY_MAX_BYTES)
    ok.repartition(n, "cache_key").write.mode("append").insertInto(table)
    spark.catalog.refreshTable(table)


def probe_bucketed(texts: DataFrame, table: str, model: str, as_of: Column, ttl_hours: int = S.CACHE_TTL_HOURS,
                   text_col: str = "text", normalize_hash: bool = False) -> DataFrame:
    """J2 over a bucketed cache: the rows of ``probe``, the cache not shuffled.

    The texts are hashed once and written with their keys, since they are read
    three times.  Distinct (key, content hash) pairs, combined before they move, go to the
    cache's buckets; their answers are joined back to the texts by a shuffle
    that splits a hot text.  The key prefixes (256 at most) are found first, so
    that a probe of few texts reads only row groups that may hold them."""
    spark = texts.sparkSession
    t = written(texts.withColumn("cache_key", cache_key(F.col(text_col), F.lit(model)))
                .withColumn("_h", content_hash(F.col(text_col), normalize_hash)), "cache-probe")
    keys = t.select("cache_key", "_h").filter(F.col("cache_key").isNotNull()).distinct()
    prefixes = [r[0] for r in keys.select(key_prefix(F.col("cache_key"))).distinct().collect()]
    cache = spark.table(table)
    if len(prefixes) < 256:
        cache = cache.filter(F.col("key_prefix").isin(prefixes))
    fresh = latest_entries(cache.select("cache_key", "model", "text_hash", "embedding", "cached_at"))
    fresh = fresh.filter(ttl_valid(F.col("cached_at"), as_of, ttl_hours)).select("cache_key", F.col("model").alias("_model"), F.col("text_hash").alias("_hash"), F.col("embedding").alias("_emb"))
    ok = F.coalesce((F.col("_model") == model) & (F.col("_hash") == F.col("_h")) & (F.size("_emb") > 0), F.lit(False))
    answers = fresh.join(keys, "cache_key").select(
        "cache_key", "_h", F.when(ok, F.lit("hit")).otherwise(F.lit("corrupt")).alias("status"), F.when(ok, F.col("_emb")).alias("embedding"))
    out = answers.join(t.drop("status", "embedding"), ["cache_key", "_h"], "right").drop("_h")
    return out.withColumn("status", F.coalesce("status", F.lit("miss"))).select(*texts.columns, "cache_key", "status", "embedding")


def oversize_entries(entries: DataFrame, max_bytes: int = S.CACHE_ENTRY_MAX_BYTES) -> DataFrame:
    """Entries rejected by the per-entry size cap."""
    return entries.filter(F.col("size_bytes") > max_bytes)


# ---------------------------------------------------------------- J2/J3
def probe(texts: DataFrame, cache: DataFrame, model: str, as_of: Column,
          ttl_hours: int = S.CACHE_TTL_HOURS, text_col: str = "text", normalize_hash: bool = False) -> DataFrame:
    """Every input text with ``cache_key`` and ``status`` in
    {hit, corrupt, miss}; hits carry the cached vector.

    Equi left join on ``cache_key`` (the cache side is reduced to the
    fresh latest version per key first, so each text matches one row).
    """
    t = texts.withColumn("cache_key", cache_key(F.col(text_col), F.lit(model)))
    fresh = latest_entries(cache).filter(ttl_valid(F.col("cached_at"), as_of, ttl_hours)) \
        .select(F.col("cache_key").alias("_ck"), F.col("model").alias("_model"),
                F.col("text_hash").alias("_hash"), F.col("embedding").alias("_emb"))
    j = t.join(fresh, t.cache_key == fresh._ck, "left")
    ok = integrity_ok(F.col(text_col), F.lit(model), F.col("_model"), F.col("_hash"), F.col("_emb"), normalize_hash)
    status = (F.when(F.col("_ck").isNull(), F.lit("miss"))
              .when(ok, F.lit("hit")).otherwise(F.lit("corrupt")))
    return (j.withColumn("status", status)
            .withColumn("embedding", F.when(F.col("status") == "hit", F.col("_emb")))
            .drop("_ck", "_model", "_hash", "_emb"))


def misses(probed: DataFrame, text_col: str = "text", id_col: str = "pos") -> DataFrame:
    """Distinct texts to embed: per cache key the raw text of the first
    row (texts that differ in white space share a key)."""
    return (probed.filter(F.col("status") != "hit").groupBy("cache_key")
            .agg(F.min_by(text_col, id_col).alias(text_col)))


def corrupt_keys(probed: DataFrame) -> DataFrame:
    """M6: keys whose entry failed the integrity check (dropped at compaction)."""
    return probed.filter(F.col("status") == "corrupt").select("cache_key").distinct()


# ---------------------------------------------------------------- E1 / J4
def embed_with_cache(texts: DataFrame, cache: DataFrame, provider: Provider, as_of: Column,
                     ttl_hours: int = S.CACHE_TTL_HOURS, text_col: str = "text",
                     id_col: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(vectors for every valid input text, new cache entries).

    P2 blank texts are excluded (use ``blank_texts`` to report them); hits
    come from the cache, misses are embedded once per distinct key and the
    result is joined back on ``cache_key`` (J4), keeping ``id_col``.
    """
    valid = texts.filter(~is_blank(F.col(text_col)))
    pr = probe(valid, cache, provider.model, as_of, ttl_hours, text_col)
    todo = misses(pr, text_col, id_col)
    fresh = provider.embed(todo, text_col, "embedding")
    new_entries = make_entries(fresh.select("cache_key", text_col, "embedding"), provider.model, as_of,
                               text_col, "embedding", key_col="cache_key")
    computed = fresh.select(F.col("cache_key").alias("_ck"), F.col("embedding").alias("_new"))
    out = (pr.join(computed, pr.cache_key == computed._ck, "left")
           .withColumn("from_cache", F.col("status") == "hit")
           .withColumn("embedding", F.coalesce(F.col("embedding"), F.col("_new")))
           .drop("_ck", "_new"))
    return out, new_entries


def blank_texts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts rejected before embedding."""
    return texts.filter(is_blank(F.col(text_col))).withColumn(
        "reject_reason", F.lit("EMPTY_TEXT"))


# ---------------------------------------------------------------- M2
def expire(cache: DataFrame, as_of: Column, ttl_hours: int = S.CACHE_TTL_HOURS) -> DataFrame:
    """M2: entries still valid at ``as_of``."""
    return cache.filter(ttl_valid(F.col("cached_at"), as_of, ttl_hours))


def compact(cache: DataFrame, as_of: Column, bad_keys: DataFrame | None = None,
            ttl_hours: int = S.CACHE_TTL_HOURS) -> DataFrame:
    """Latest fresh version per key, minus corrupt keys (M1+M2+M6)."""
    out = expire(latest_entries(cache), as_of, ttl_hours)
    if bad_keys is not None:
        out = out.join(bad_keys, "cache_key", "left_anti")
    return out


# ---------------------------------------------------------------- M3
def evict_oldest(cache: DataFrame, max_bytes: int = S.CACHE_MAX_BYTES,
                 ratio: float = S.CACHE_TARGET_RATIO, n_ranges: int | None = None) -> DataFrame:
    """M3: (cached_at, cache_key, size_bytes, evicted); entries are evicted when
    the total exceeds ``max_bytes``, oldest first (cached_at, then key), until
    it is at most ``ratio * max_bytes``.  Texts and vectors do not move.

    An entry is evicted iff ``total > max`` and ``total - size of strictly
    older entries > target``.  The prefix sums are distributed
    (``running_totals``: range partitions, per-partition prefix, partition
    offsets), so no global single-task window is used.
    """
    from tenderlake.operators.running import running_totals
    r = running_totals(cache, [], ["cached_at", "cache_key"], "size_bytes", n_ranges,
                       with_total=True)
    target = float(max_bytes) * ratio
    evicted = (F.col("group_total") > F.lit(max_bytes)) & \
        ((F.col("group_total") - F.col("before_sum")) > F.lit(target))
    return r.select("cached_at", "cache_key", "size_bytes", evicted.alias("evicted"))


# ---------------------------------------------------------------- A5/A6/M4/M5
def cache_stats(probed: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of request, hit, miss, error counts, hit rate,
    savings (hits × words × 1.3 / 1000 × price, price fixed whatever the
    model) and total cache size.  Probe rows and cache rows are unioned and
    aggregated in one pass (no join of the two one-row results)."""
    st = F.col("status")
    saving = word_count(F.col(text_col)).cast("double") * F.lit(S.TOKENS_PER_WORD) \
        / F.lit(1000.0) * F.lit(S.CACHE_SAVING_PRICE)
    p = probed.select(F.lit(True).alias("_probe"), st.alias("status"),
                      F.when(st == "hit", saving).otherwise(F.lit(0.0)).alias("_saving"),
                      F.lit(None).cast("bigint").alias("size_bytes"))
    c = cache.select(F.lit(False).alias("_probe"), F.lit(None).cast("string").alias("status"),
                     F.lit(0.0).alias("_saving"), F.col("size_bytes"))
    pr = F.col("_probe")
    a = p.unionByName(c).agg(
        F.count_if(pr).alias("total_requests"),
        F.count_if(pr & (st == "hit")).alias("cache_hits"),
        F.count_if(pr & (st != "hit")).alias("cache_misses"),
        F.count_if(pr & (st == "corrupt")).alias("cache_errors"),
        F.sum("_saving").alias("total_savings_usd"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("cache_size_bytes"),
        F.count_if(~pr).alias("entries"))
    return a.select(
        "total_requests", "cache_hits", "cache_misses", "cache_errors",
        F.round(F.try_divide(F.col("cache_hits").cast("double"), F.col("total_requests")), 6)
        .alias("hit_rate"),
        F.round("total_savings_usd", 9).alias("total_savings_usd"),
        "cache_size_bytes", "entries")


def clear_report(cache: DataFrame) -> DataFrame:
    """M5: what a clear removes (entries and bytes); the caller then
    overwrites the table with an empty frame."""
    return cache.agg(F.count(F.lit(1)).alias("cleared_entries"),
                     F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("cleared_bytes"))
