"""Document ingestion as a batch job (validate → ids → metadata → embed →
append → summary) and collection management.

Input rows: ``batch_id, collection, content`` plus optional ``pos`` (index
inside the batch), ``doc_id`` (caller id) and typed metadata columns.  A
batch is what one add-documents call carried: it is accepted or rejected
as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.text import is_blank, word_count
from tenderlake.operators.blocks import checked_broadcast
from tenderlake.operators.providers import Provider


# ---------------------------------------------------------------- S1 / S9
def default_collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, d, True) for n, d in S.DEFAULT_COLLECTIONS],
        "name string, description string, is_default boolean")


def register_collections(existing: DataFrame, names: DataFrame) -> DataFrame:
    """``existing`` plus every name in ``names`` not yet registered
    (left anti join, idempotent).  New collections get the default
    description when they have one, else an empty one."""
    defaults = default_collections(existing.sparkSession).select(
        F.col("name").alias("_n"), F.col("description").alias("_d"))
    new = (names.select(F.col("collection").alias("name")).distinct()
           .join(existing.select("name"), "name", "left_anti"))
    new = (new.join(F.broadcast(defaults), new.name == defaults._n, "left")  # 5 rows
           .select("name", F.coalesce(F.col("_d"), F.lit("")).alias("description"),
                   F.col("_n").isNotNull().alias("is_default")))
    return existing.unionByName(new)


def collection_counts(collections: DataFrame, corpus: DataFrame) -> DataFrame:
    """Document count per registered collection (0 when empty)."""
    counts = corpus.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return (collections.join(counts, collections.name == counts.collection, "left")
            .select("name", "description",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("document_count")))


# ---------------------------------------------------------------- S3 / J5
def explode_batches(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with parallel arrays ``documents, metadatas?, ids?`` →
    one row per document (``pos`` from ``posexplode``).  Calls whose array
    lengths differ are returned as rejected."""
    cols = set(calls.columns)
    n = F.size("documents")
    ok = F.lit(True)
    if "metadatas" in cols:
        ok = ok & (F.col("metadatas").isNull() | (F.size("metadatas") == n))
    if "ids" in cols:
        ok = ok & (F.col("ids").isNull() | (F.size("ids") == n))
    good = calls.filter(ok)
    bad = calls.filter(~ok).select("batch_id", "collection",
                                   F.lit("LENGTH_MISMATCH").alias("reject_reason"))
    rows = good.select("batch_id", "collection", F.posexplode("documents").alias("pos", "content"),
                       *(["metadatas"] if "metadatas" in cols else []),
                       *(["ids"] if "ids" in cols else []))
    if "metadatas" in cols:
        rows = rows.withColumn("extra", F.try_element_at("metadatas", F.col("pos") + 1)).drop("metadatas")
    if "ids" in cols:
        rows = rows.withColumn("doc_id", F.try_element_at("ids", F.col("pos") + 1)).drop("ids")
    return rows, bad


def batch_verdicts(docs: DataFrame) -> DataFrame:
    """S3: a row a batch: its documents, and whether none of them is blank."""
    return docs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("documents"),
                                        F.bool_and(~is_blank(F.col("content"))).alias("accepted"))


def validate_batches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: a batch with any blank document (or none at all) is rejected as
    a whole.  The verdict is one aggregate row per batch joined back with a
    semi join (no window over a possibly huge batch)."""
    verdict = batch_verdicts(docs)
    good_ids = checked_broadcast(verdict.filter("accepted").select("batch_id"))
    bad_ids = checked_broadcast(verdict.filter("not accepted").select("batch_id"))
    return (docs.join(good_ids, "batch_id", "left_semi"),
            docs.join(bad_ids, "batch_id", "left_semi")
            .withColumn("reject_reason", F.lit("EMPTY_DOCUMENT_IN_BATCH")))


# ---------------------------------------------------------------- S4 / S5
def with_submission_time(docs: DataFrame, base_ts: Column, order_col: str) -> DataFrame:
    """Give every batch (one add-documents call) its own submission time,
    ``base_ts`` plus the smallest ``order_col`` of the batch in milliseconds,
    so generated ids of different calls never collide.  One aggregate row
    per batch joined back on ``batch_id``."""
    first = checked_broadcast(docs.groupBy("batch_id").agg(F.min(order_col).alias("_first")))
    return (docs.join(first, "batch_id")
            .withColumn("submitted_at",
                        F.timestamp_millis(F.unix_millis(base_ts) + F.col("_first").cast("bigint")))
            .drop("_first"))



def assign_ids(docs: DataFrame, batch_ts: Column, order_col: str = "content") -> DataFrame:
    """``{collection}_{epoch_ms}_{pos}`` where no id was given; ``pos``
    is the index inside the batch (computed per batch by ``order_col`` when
    the rows do not carry it already)."""
    if "pos" not in docs.columns:
        # distributed per-batch numbering of (batch, order) alone: a batch holding a
        # third of the rows is spread over range partitions, no text is moved
        from tenderlake.operators.running import running_totals
        at = (running_totals(docs.select("batch_id", order_col).withColumn("_one", F.lit(1.0)), ["batch_id"], [order_col], "_one")
              .select(F.col("batch_id").alias("_b"), F.col(order_col).alias("_o"), F.col("before_count").alias("pos")))
        docs = docs.join(at, docs["batch_id"].eqNullSafe(at["_b"]) & (docs[order_col] == at["_o"])).drop("_b", "_o")
    gen = F.concat_ws("_", F.col("collection"), F.unix_millis(batch_ts).cast("string"),
                      F.col("pos").cast("string"))
    given = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("doc_id", F.coalesce(given, gen))


FORCED_KEYS = ["added_at", "collection", "document_length", "engine_version"]


def enrich_metadata(docs: DataFrame, batch_ts: Column) -> DataFrame:
    """Forced keys win over user keys (typed columns and the free map)."""
    out = docs.withColumns({
        "added_at": batch_ts.cast("timestamp"),
        "document_length": F.length("content").cast("int"),
        "engine_version": F.lit(S.ENGINE_VERSION),
    })
    if "extra" in out.columns:
        forced = F.array(*[F.lit(k) for k in FORCED_KEYS])
        out = out.withColumn("extra", F.map_filter(
            F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>")),
            lambda k, v: ~F.array_contains(forced, k)))
    return out


# ---------------------------------------------------------------- S6 / S7
def dedupe_against(new_docs: DataFrame, existing: DataFrame | None,
                   order: list[str] | None = None) -> DataFrame:
    """S6 policy: the first write of an id wins: of equal new ids the first by
    ``order`` (unique within an id), and none that ``existing`` has (left anti
    join on doc_id).  The firsts are found on ids and order columns alone, with
    map-side combination, so that an id used very often is no single task and
    texts do not move for it; ``first_write`` keeps filters of stored ids."""
    if order:
        first = new_docs.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("_o")).select(F.col("doc_id").alias("_id"), *[F.col(f"_o.{c}").alias(f"_o_{c}") for c in order])
        on = new_docs["doc_id"].eqNullSafe(first["_id"])
        for c in order:
            on = on & new_docs[c].eqNullSafe(first[f"_o_{c}"])
        new_docs = new_docs.join(first, on, "left_semi")
    if existing is None:
        return new_docs
    return new_docs.join(existing.select("doc_id"), "doc_id", "left_anti")


def ingest(docs: DataFrame, provider: Provider | None, batch_ts: Column,
           existing: DataFrame | None = None, order_col: str = "content"
           ) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the corpus, rejected rows).  ``provider=None``
    leaves the embedding to a later job."""
    good, bad = validate_batches(docs)
    rows = enrich_metadata(assign_ids(good, batch_ts, order_col), batch_ts)
    # generated ids are unique; ids that callers gave may come twice
    rows = dedupe_against(rows, existing, ["added_at", order_col] if "doc_id" in docs.columns else None)
    if provider is not None:
        rows = provider.embed(rows, "content", "embedding")
    return rows, bad


def append_to_corpus(rows: DataFrame, path: str) -> None:
    """Partitioned append (one folder per collection)."""
    rows.write.mode("append").partitionBy("collection").parquet(path)


def read_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """One collection; the literal predicate prunes the other folders."""
    return spark.read.parquet(path).filter(F.col("collection") == collection)


def price_table(spark: SparkSession) -> DataFrame:
    """model dimension, price per 1k tokens and token limit (3 rows)."""
    return spark.createDataFrame(S.MODELS, "model string, dimension int, price_per_1k double, "
                                           "max_tokens int")


def model_price(model: str) -> float:
    return next((p for m, _, p, _ in S.MODELS if m == model), S.UNKNOWN_MODEL_PRICE)


def ingest_summary(rows: DataFrame, model: str) -> DataFrame:
    """S7 + A4: per (collection, batch): documents, characters, token
    estimate (words × 1.3, truncated once on the batch total) and cost."""
    g = rows.groupBy("collection", "batch_id").agg(
        F.count(F.lit(1)).alias("documents_added"),
        F.sum(F.length("content")).cast("bigint").alias("total_characters"),
        F.sum(word_count(F.col("content"))).cast("bigint").alias("_words"))
    tokens = F.floor(F.col("_words").cast("double") * F.lit(S.TOKENS_PER_WORD)).cast("bigint")
    return g.select("collection", "batch_id", "documents_added", "total_characters",
                    tokens.alias("estimated_tokens"),
                    F.round(tokens.cast("double") / F.lit(1000.0) * F.lit(model_price(model)), 9)
                    .alias("estimated_cost_usd"))
