"""Further registered queries: limits and cuts of the search, checks on rows
that violate them, the cache's life cycle, streams' data as logs, and search
quality against labels.  Same contract as ``registry``."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.predicates import filter_predicate
from tenderlake.operators import cache as C
from tenderlake.operators import ingest as IG
from tenderlake.operators import market as MK
from tenderlake.operators import profile as PR
from tenderlake.operators import reports as RP
from tenderlake.operators.providers import HashedTF
from tenderlake.operators.search import (SearchOptions, attach_documents, knn_candidates, prepare_requests, score_violations, search,
                                         wrong_dimension)
from tenderlake.plans import oracle as O
from tenderlake.plans.registry import _as_of, _ingest_ts, _ts, register
from tenderlake.session import scratch_path
from tenderlake.sources import fixtures as fx
from tenderlake.sources.logs import read_log, write_log
from tenderlake.streaming import streams as ST

# ------------------------------------------------------------------ search limits
PLAIN_REQUESTS = """requests AS (
  SELECT doc_id AS query_id, content AS query, collection, 5 AS "limit", 1.0::DOUBLE AS min_similarity,
    false AS has_ctx, NULL::VARCHAR AS ao_type, NULL::VARCHAR AS sector, NULL::BIGINT AS estimated_amount,
    NULL::VARCHAR[] AS technical_domains, NULL::VARCHAR AS organisme FROM corpus)"""


def _plain_requests(spark, sf_dir, **columns):
    return fx.corpus(spark, sf_dir, embedding="none").select(
        F.col("doc_id").alias("query_id"), F.col("content").alias("query"), "collection",
        F.lit(None).cast(S.CONTEXT_TYPE).alias("ctx"), *[F.lit(v).alias(c) for c, v in columns.items()])


@register("p6_inclusive_cut", O.search_sql(PLAIN_REQUESTS, "l2sq"))
def inclusive_cut(spark, sf_dir):
    """min_similarity 1.0 keeps exact copies (similarity equal to the cut)."""
    return search(_plain_requests(spark, sf_dir, limit=5, min_similarity=1.0), fx.corpus(spark, sf_dir))


@register("j1_limit_100", O.search_sql(
    O.CONV_REQUESTS_ANY.replace(f'{S.DEFAULT_LIMIT} AS "limit"', '100 AS "limit"'), "l2sq",
    select="SELECT query_id, doc_id, cand_rank, round(similarity, 6) AS similarity FROM cands"))
def limit_100(spark, sf_dir):
    """J1 + W1: the largest limit gives all 200 candidates a request."""
    good, _ = prepare_requests(fx.conversation_queries(spark, sf_dir, limit=100, min_similarity=0.0), HashedTF())
    c = knn_candidates(good, fx.corpus(spark, sf_dir), 64)
    return c.select("query_id", "doc_id", "cand_rank", F.round("similarity", 6).alias("similarity"))


@register("search_stored_corpus", O.search_sql(O.CONV_REQUESTS, "cosine"))
def search_stored_corpus(spark, sf_dir):
    """S6 + S8 + J1: vectors are embedded once, at ingestion; the search reads
    the stored, collection-partitioned corpus."""
    path = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    IG.append_to_corpus(fx.corpus(spark, sf_dir), path)
    return search(fx.conversation_queries(spark, sf_dir), spark.read.parquet(path), opts=SearchOptions(metric="cosine", stored=True))


# ------------------------------------------------------------------ checks on rows that violate them
@register("p7_score_violations", "WITH res AS (" + O.search_sql(O.DOC_REQUESTS, "l2sq") + """)
SELECT query_id, rank, doc_id FROM res WHERE query_id % 7 = 0 OR query_id % 7 = 1""")
def score_violations_q(spark, sf_dir):
    """Results outside [0, 1]; a part of the scores is moved out of it first."""
    r = search(fx.document_queries(spark, sf_dir), fx.corpus(spark, sf_dir))
    k = F.pmod("query_id", F.lit(7))
    r = (r.withColumn("similarity_score", F.when(k == 0, F.col("similarity_score") + 1).otherwise(F.col("similarity_score")))
         .withColumn("relevance_score", F.when(k == 1, -F.col("relevance_score")).otherwise(F.col("relevance_score"))))
    return score_violations(r).select("query_id", "rank", "doc_id")


@register("p10_null_lists", f"""WITH {O.ORDER_META}, {O.TENDER_DOMAINS}, {O.TENDERS},
n AS (SELECT tender_id, CASE WHEN tender_id % 11 = 0 THEN []::VARCHAR[] ELSE technical_domains END AS technical_domains,
        CASE WHEN tender_id % 11 IN (0, 1) THEN MAP([]::VARCHAR[], []::INTEGER[]) ELSE criteria_weights END AS criteria_weights
      FROM tenders)
SELECT tender_id, CAST(len(technical_domains) AS INTEGER) AS domains, {O.complexity_sql('technical_domains')} AS technical_complexity,
  round({O.PRICE_SENS}, 6) AS price_sensitivity, {O.WEIGHTS_TOTAL} AS weights_total FROM n""")
def null_lists(spark, sf_dir):
    """P10: null domains and null weights count as empty ones."""
    t = fx.tenders(spark, sf_dir)
    k = F.pmod("tender_id", F.lit(11))
    t = (t.withColumn("technical_domains", F.when(k != 0, F.col("technical_domains")))
         .withColumn("criteria_weights", F.when(~k.isin(0, 1), F.col("criteria_weights"))))
    p = PR.profile_tenders(t)
    return p.select("tender_id", F.size("technical_domains").alias("domains"), "technical_complexity",
                    F.round("price_sensitivity", 6).alias("price_sensitivity"), "weights_total")


@register("p11_quarantine", """SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 32 WHEN vec_id % 10 = 4 THEN NULL
  ELSE CAST(len(embedding) AS INTEGER) END AS dimension, 'WRONG_DIMENSION' AS reject_reason FROM embeddings
WHERE vec_id % 10 IN (3, 4) OR len(embedding) <> 64""")
def quarantine(spark, sf_dir):
    """Vectors that are missing or have another dimension than the
    model's; a part of the stored vectors is cut or removed first."""
    k = F.pmod("vec_id", F.lit(10))
    e = fx.read_table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.when(k == 3, F.slice("embedding", 1, 32)).when(k != 4, F.col("embedding")))
    return wrong_dimension(e, 64).select("vec_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"),
                                         F.lit("WRONG_DIMENSION").alias("reject_reason"))


ENTRY_CAP = 2000  # bytes; a test parameter that part of the documents exceeds


@register("p13_oversize_entries", f"""SELECT {O.cache_key_sql('text')} AS cache_key, CAST(256 + strlen(text) AS BIGINT) AS size_bytes
FROM documents WHERE 256 + strlen(text) > {ENTRY_CAP}""")
def oversize_entries_q(spark, sf_dir):
    """Entries over a cap on their size are not written."""
    d = fx.read_table(spark, sf_dir, "documents").select("text")
    e = C.make_entries(d.withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)), fx.CACHE_MODEL, _as_of())
    return C.oversize_entries(e, ENTRY_CAP).select("cache_key", "size_bytes")


FILTER = {"$and": [{"organisme": {"$like": "%CHU%"}}, {"$or": [{"montant": {"$gte": 100000}}, {"type_ao": "MAPA"}]}],
          "secteur": {"$nin": ["Défense"]}, "domaine_technique": {"$ne": S.DOMAINS[0]}}


@register("p5_filter_operators", f"""WITH {O.ORDER_META}, {O.CORPUS}
SELECT doc_id, organisme, type_ao, montant FROM corpus WHERE organisme LIKE '%CHU%' AND (montant >= 100000 OR type_ao = 'MAPA')
  AND secteur NOT IN ('Défense') AND domaine_technique <> '{S.DOMAINS[0]}'""")
def filter_operators(spark, sf_dir):
    """P5: $like, $and, $or, $gte, $nin and $ne on typed columns."""
    return fx.corpus(spark, sf_dir, embedding="none").filter(filter_predicate(FILTER)).select("doc_id", "organisme", "type_ao", "montant")


@register("j5_explode_calls", """WITH turns AS (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id AS batch_id, CAST(pos AS INTEGER) AS pos, length(text) AS chars, CAST(pos AS VARCHAR) AS meta_turn, NULL AS reject_reason
FROM turns WHERE conv_id % 5 <> 0
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, 'LENGTH_MISMATCH' FROM turns WHERE conv_id % 5 = 0""")
def explode_calls(spark, sf_dir):
    """Add-documents calls with parallel arrays (a call is a conversation's
    turns: small and bounded); calls of unequal lengths are rejected."""
    c = fx.read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    metas = F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.create_map(F.lit("turn"), i.cast("string")))
    calls = c.select(F.col("conv_id").alias("batch_id"), F.lit(S.DEFAULT_COLLECTION).alias("collection"),
                     F.col("t.text").alias("documents"),
                     F.when(F.pmod("conv_id", F.lit(5)) == 0, F.slice(metas, 1, F.size("t") - 1)).otherwise(metas).alias("metadatas"))
    rows, bad = IG.explode_batches(calls)
    a = rows.select("batch_id", "pos", F.length("content").cast("bigint").alias("chars"),
                    F.try_element_at("extra", F.lit("turn")).alias("meta_turn"), F.lit(None).cast("string").alias("reject_reason"))
    return a.unionByName(bad.select("batch_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("bigint").alias("chars"),
                                    F.lit(None).cast("string").alias("meta_turn"), "reject_reason"))


@register("s6_equal_ids", f"""WITH {O.BATCHES}
SELECT doc_id, min(source_doc) AS source_doc FROM (
  SELECT collection || '-' || coalesce(lang, '') || '-' || CAST(source_doc % 17 AS VARCHAR) AS doc_id, source_doc FROM good
  WHERE batch_id <> 'benchmark') GROUP BY doc_id""")
def equal_ids(spark, sf_dir):
    """Of documents that callers gave equal ids, the first write wins."""
    b = fx.document_batches(spark, sf_dir)
    b = b.withColumn("doc_id", F.concat_ws("-", "collection", F.coalesce(F.col("extra")["lang"], F.lit("")),
                                           F.pmod("source_doc", F.lit(17)).cast("string")))
    rows, _ = IG.ingest(b, None, _ingest_ts(), order_col="source_doc")
    return rows.select("doc_id", "source_doc")


# ------------------------------------------------------------------ cache
@register("f13_normalized_hash", f"""SELECT doc_id AS pos,
  CASE WHEN regexp_replace(text, ' ', '  ', 'g') = text THEN 'hit' ELSE 'corrupt' END AS status_raw, 'hit' AS status_normalized
FROM documents WHERE NOT (text IS NULL OR regexp_matches(text, '^\\s*$'))""")
def normalized_hash(spark, sf_dir):
    """with ``normalize_hash`` texts that differ in white space alone are
    hits; without it their entry fails the integrity check."""
    docs = fx.text_batch(spark, sf_dir).filter(~C.is_blank(F.col("text")))
    stored = docs.withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), 64))
    spaced = docs.withColumn("text", F.regexp_replace("text", " ", "  "))
    out = []
    for normalize in (False, True):
        # of copies any entry will do: their hashes are equal unless white space differs
        cache = C.make_entries(stored, fx.CACHE_MODEL, _as_of(), normalize_hash=normalize)
        own = C.probe(spaced.withColumn("raw", F.regexp_replace("text", "  ", " ")), cache, fx.CACHE_MODEL, _as_of(),
                      normalize_hash=normalize)
        out.append(own.select("pos", F.col("status").alias("status_normalized" if normalize else "status_raw")))
    return out[0].join(out[1], "pos")


@register("m1_cache_lifecycle", f"""WITH {O.CACHE},
newe AS (SELECT cache_key, {O.CACHE_AS_OF} AS cached_at, md5(text) AS text_hash, CAST(256 + strlen(text) AS BIGINT) AS size_bytes
         FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY pos) AS r FROM probed WHERE status <> 'hit') WHERE r = 1),
kept AS (SELECT cache_key, cached_at, text_hash, size_bytes FROM fresh
         WHERE cache_key NOT IN (SELECT cache_key FROM probed WHERE status = 'corrupt')),
u AS (SELECT * FROM kept UNION ALL SELECT * FROM newe)
SELECT cache_key, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at, text_hash, size_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, text_hash DESC) AS v FROM u) WHERE v = 1""")
def cache_lifecycle(spark, sf_dir):
    """M1 + M2 + M6: the cache table is written, probed, compacted (expired and
    corrupt entries go), appended to, and read again."""
    first, second = (scratch_path(spark, f"cache-{uuid.uuid4().hex}") for _ in range(2))
    C.write_cache(fx.cache_table(spark, sf_dir), first)
    cache = spark.read.parquet(first)
    texts = fx.text_batch(spark, sf_dir)
    _, new = C.embed_with_cache(texts, cache, HashedTF(64), _as_of())
    bad = C.corrupt_keys(C.probe(texts.filter(~C.is_blank(F.col("text"))), cache, fx.CACHE_MODEL, _as_of()))
    C.write_cache(C.compact(cache, _as_of(), bad), second)
    C.write_cache(new, second)
    return C.latest_entries(spark.read.parquet(second)).select("cache_key", _ts(F.col("cached_at")).alias("cached_at"),
                                                               "text_hash", "size_bytes")


@register("j2_bucketed_probe", O.J2_PROBE)
def bucketed_probe(spark, sf_dir):
    """Texts probed against a bucketed cache table, which is not shuffled."""
    table = C.open_bucketed_cache(spark, scratch_path(spark, f"cache-{uuid.uuid4().hex}"))
    C.append_bucketed(fx.cache_table(spark, sf_dir), table)
    valid = fx.text_batch(spark, sf_dir).filter(~C.is_blank(F.col("text")))
    return C.probe_bucketed(valid, table, fx.CACHE_MODEL, _as_of()).select("pos", "cache_key", "status")


@register("m1_bucketed_upsert", O.M1_UPSERT)
def bucketed_upsert(spark, sf_dir):
    """M1: the entries of the misses appended to a bucketed cache table; the
    newest version of each key is found without shuffling it."""
    table = C.open_bucketed_cache(spark, scratch_path(spark, f"cache-{uuid.uuid4().hex}"))
    C.append_bucketed(fx.cache_table(spark, sf_dir), table)
    valid = fx.text_batch(spark, sf_dir).filter(~C.is_blank(F.col("text")))
    todo = C.misses(C.probe_bucketed(valid, table, fx.CACHE_MODEL, _as_of()))
    C.append_bucketed(C.make_entries(HashedTF(64).embed(todo, "text", "embedding"), fx.CACHE_MODEL, _as_of(), key_col="cache_key"), table)
    return C.latest_entries(spark.table(table).select("cache_key", "cached_at", "size_bytes", "text_hash")).select("cache_key", _ts(F.col("cached_at")).alias("cached_at"), "size_bytes", "text_hash")


OBSERVED_SQL = f"""WITH {O.CACHE}, t AS (SELECT doc_id, text, lang FROM documents)
SELECT 'add_documents' AS operation, TRUE AS success, (SELECT count(*) FROM t) AS documents,
  (SELECT coalesce(sum(len(regexp_extract_all(text, '\\S+'))), 0)::BIGINT FROM t) AS tokens, NULL::BOOLEAN AS cache_hit,
  (SELECT count(DISTINCT lang)::VARCHAR FROM t) AS languages
UNION ALL SELECT 'cache_probe', TRUE, (SELECT count(*) FROM probed), NULL, (SELECT coalesce(bool_and(status = 'hit'), FALSE) FROM probed), NULL
UNION ALL SELECT 'cache_hits', TRUE, (SELECT count(*) FROM probed WHERE status = 'hit'), NULL,
  (SELECT count(*) > 0 FROM probed WHERE status = 'hit'), NULL
UNION ALL SELECT 'write_again', FALSE, NULL, NULL, NULL, NULL"""


@register("s12_observed_log", OBSERVED_SQL)
def observed_log(spark, sf_dir):
    """Operators run under observation; the log they leave holds the counts
    of their rows, taken while they ran, and the run that failed."""
    from tenderlake.operators.observed import ObservedLog
    from tenderlake.plans.registry import _probed
    base = scratch_path(spark, f"observed-{uuid.uuid4().hex}")
    log = ObservedLog(spark, f"{base}/log")
    docs = fx.read_table(spark, sf_dir, "documents")
    log.run("add_documents", docs.select("doc_id", "text", "lang"), f"{base}/docs", text_col="text",
            languages=F.size(F.collect_set("lang")))
    probed = log.run("cache_probe", _probed(spark, sf_dir).select("pos", "status"), f"{base}/probe", hit=F.col("status") == "hit")
    log.run("cache_hits", probed.filter(F.col("status") == "hit"), f"{base}/hits", hit=F.col("status") == "hit")
    try:  # a folder that holds rows is not written again
        log.run("write_again", probed, f"{base}/probe", mode="errorifexists")
    except AnalysisException:
        pass
    return read_log(spark, f"{base}/log").select("operation", "success", "documents", "tokens", "cache_hit",
                                                 F.col("context")["languages"].alias("languages"))


# ------------------------------------------------------------------ results with their documents
def _result_documents_sql(select: str) -> str:
    return "WITH res AS (" + O.search_sql(O.DOC_REQUESTS, "l2sq") + f"), {O.ORDER_META}, {O.CORPUS} {select}"


RESULT_DOCUMENTS = _result_documents_sql("""
SELECT r.query_id, r.rank, r.doc_id, r.similarity_score, c.content,
  to_json({'secteur': c.secteur, 'type_ao': c.type_ao, 'fourchette_montant': c.fourchette_montant,
           'domaine_technique': c.domaine_technique, 'organisme': c.organisme, 'zone_geo': c.zone_geo}) AS metadata
FROM res r JOIN corpus c ON c.doc_id = r.doc_id""")


@register("p8_results_with_documents", RESULT_DOCUMENTS)
def results_with_documents(spark, sf_dir):
    """Results with the content and the metadata of their documents,
    joined after the top-k."""
    corp = fx.corpus(spark, sf_dir)
    r = attach_documents(search(fx.document_queries(spark, sf_dir), corp), corp)
    return r.select("query_id", "rank", "doc_id", "similarity_score", "content",
                    F.to_json("metadata").alias("metadata"))


@register("s10_export_fields", _result_documents_sql("""
SELECT r.query_id, r.rank, r.doc_id, r.similarity_score, r.relevance_score, r.confidence_level, r.is_highly_relevant,
  length(c.content) AS content_chars, c.organisme AS meta_organisme FROM res r JOIN corpus c ON c.doc_id = r.doc_id"""))
def export_fields(spark, sf_dir):
    """Results exported as JSON lines with content and metadata, read
    back and parsed."""
    from tenderlake.operators.search import export_results
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    corp = fx.corpus(spark, sf_dir)
    export_results(attach_documents(search(fx.document_queries(spark, sf_dir), corp), corp), path)
    back = spark.read.schema("query_id bigint, rank int, doc_id bigint, similarity_score double, relevance_score double, confidence_level string, "
                             "is_highly_relevant boolean, content string, metadata struct<organisme:string>").json(path)
    return back.select("query_id", "rank", "doc_id", "similarity_score", "relevance_score", "confidence_level", "is_highly_relevant",
                       F.length("content").cast("bigint").alias("content_chars"), F.col("metadata.organisme").alias("meta_organisme"))


@register("s11_export_tenders", f"""WITH {O.ORDER_META}, {O.TENDER_DOMAINS}, {O.TENDERS}
SELECT tender_id, {O.bucket_sql('estimated_amount')} AS amount_range, {O.complexity_sql('technical_domains')} AS technical_complexity,
  {O.WEIGHTS_TOTAL} AS weights_total, CAST(len(technical_domains) AS INTEGER) AS domains FROM tenders""")
def export_tenders(spark, sf_dir):
    """Profiled tenders exported as JSON lines, read back and parsed."""
    path = scratch_path(spark, f"tenders-{uuid.uuid4().hex}")
    PR.export_tenders(PR.profile_tenders(fx.tenders(spark, sf_dir)), path)
    back = spark.read.schema("tender_id bigint, amount_range string, technical_complexity string, weights_total bigint, "
                             "technical_domains array<string>").json(path)
    return back.select("tender_id", "amount_range", "technical_complexity", "weights_total",
                       F.size("technical_domains").alias("domains"))


@register("b15_precision_recall", "WITH res AS (" + O.search_sql(O.DOC_REQUESTS, "l2sq") + f"""), {O.ORDER_META}, {O.CORPUS},
l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
p AS (SELECT r.collection, count(*) AS judged, count(*) FILTER (WHERE quality = 1) AS relevant,
        count(DISTINCT CASE WHEN quality = 1 THEN r.doc_id END) AS found FROM res r JOIN l USING (doc_id) GROUP BY r.collection),
a AS (SELECT collection, count(*) AS wanted FROM corpus JOIN l USING (doc_id) WHERE quality = 1 GROUP BY collection)
SELECT a.collection, coalesce(judged, 0) AS judged, round(relevant::DOUBLE / judged, 6) AS precision_at_k,
  round(coalesce(found, 0)::DOUBLE / wanted, 6) AS recall_at_k FROM a LEFT JOIN p ON a.collection = p.collection""")
def precision_recall(spark, sf_dir):
    """precision@k and recall@k per collection, a document being
    relevant when its label says so."""
    corp = fx.corpus(spark, sf_dir)
    labels = fx.read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return MK.precision_recall(search(fx.document_queries(spark, sf_dir), corp), corp.select("doc_id", "collection"),
                               labels.select("doc_id", (F.col("quality") == 1).alias("relevant")))


# ------------------------------------------------------------------ embedding calls, first writes, rollups
@register("e2_ledger_embed", O.E2_ARROW)
def ledger_embed(spark, sf_dir):
    """A user model behind a ledger of finished chunks; the second run
    finds every vector stored and calls nothing."""
    from tenderlake.operators.ledger import embed_with_ledger
    from tenderlake.operators.providers import hashed_tf_numpy
    path = scratch_path(spark, f"ledger-{uuid.uuid4().hex}")
    for _ in range(2):
        out = embed_with_ledger(fx.text_batch(spark, sf_dir), "text", hashed_tf_numpy, 64, "hashed-tf-64-numpy", path)
    return out.select("pos", F.size("embedding").cast("int").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vsum"))


@register("e3_cost_estimate", f"""WITH w AS (SELECT coalesce(len({O._WORDS.format(x='text')}), 0) AS n FROM documents),
t AS (SELECT count(*) AS texts, CAST(floor(coalesce(sum(n), 0)::DOUBLE * 1.3::DOUBLE) AS BIGINT) AS tokens, count(*) FILTER (n * 1.3::DOUBLE > 8191) AS over_limit FROM w)
SELECT texts, tokens, over_limit, round(tokens::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE, 9) AS cost_usd FROM t""")
def cost_estimate(spark, sf_dir):
    """What embedding all documents with the default model would cost."""
    from tenderlake.operators.providers import ArrowProvider, hashed_tf_numpy
    return ArrowProvider(hashed_tf_numpy, 64, S.DEFAULT_MODEL).estimate(fx.text_batch(spark, sf_dir), "text")


@register("s6_first_write_wins", """SELECT doc_id // 4 AS doc_id, arg_min(doc_id, doc_id % 3 * 1000000000000 + doc_id) AS source_doc,
  min(doc_id % 3)::INTEGER AS append FROM documents GROUP BY doc_id // 4""")
def first_write_wins(spark, sf_dir):
    """Three appends that share ids; filters of stored ids decide what is read."""
    from tenderlake.operators.first_write import append_first_writes, read_table as read_appends
    path = scratch_path(spark, f"appends-{uuid.uuid4().hex}")
    docs = fx.read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), F.col("doc_id").alias("source_doc"), "text")
    for n in range(3):
        append_first_writes(docs.filter(F.pmod("source_doc", F.lit(3)) == n), path, ["source_doc"])
    return read_appends(spark, path).select("doc_id", "source_doc", F.col("commit").alias("append"))


@register("a9_rollup", f"""WITH {O.OP_LOG}
SELECT operation, model, strftime(ts, '%Y-%m-%d') AS day, GROUPING(operation, model, strftime(ts, '%Y-%m-%d'))::INTEGER AS level, count(*) AS operations,
  count(*) FILTER (success) AS successes, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM op_log GROUP BY ROLLUP (operation, model, strftime(ts, '%Y-%m-%d'))""")
def operations_rollup(spark, sf_dir):
    """A9 + A1: operations by operation, model and day, with all subtotals."""
    return RP.operations_rollup(fx.op_log(spark, sf_dir))


# ------------------------------------------------------------------ streams with late rows
ARRIVALS = f"""{O.OP_LOG},
a AS (SELECT *, ts + CASE WHEN event_id % 50 = 7 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS arrival FROM op_log),
b AS (SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // ((SELECT count(*) + {ST.LATE_BATCHES - 1} FROM op_log) // {ST.LATE_BATCHES}) AS batch FROM a),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM b GROUP BY batch),
j AS (SELECT b.*, mark, coalesce(ts < mark, false) AS late FROM b JOIN m USING (batch))"""


@register("t3_late_rows", f"""WITH {ARRIVALS}
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, strftime(mark, '%Y-%m-%d %H:%M:%S.%f') AS watermark FROM j WHERE late""")
def late_rows(spark, sf_dir):
    """Rows behind the watermark are set aside with it, not dropped in silence."""
    _, late = ST.run_late_arrivals(spark, sf_dir)
    return late.select("event_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("ts", "watermark")])


@register("t3_sliding_alerts", f"""WITH {ARRIVALS},
w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS w, * FROM j, range(24) r(h) WHERE NOT late),
d AS (SELECT w, count(*) FILTER (WHERE operation = 'rag_search') AS requests,
        sum(CASE WHEN operation = 'rag_search' THEN CAST(round(duration_ms * 100.0) AS BIGINT) END) AS lat_c, count(*) FILTER (WHERE cache_hit) AS hits,
        coalesce(sum(tokens), 0) AS tok, count(*) FILTER (WHERE NOT success) AS err, count(*) AS n FROM w GROUP BY w),
k AS (SELECT w, requests, CASE WHEN requests = 0 THEN NULL ELSE lat_c::DOUBLE / (requests * 100.0::DOUBLE) END AS lat,
        CASE WHEN requests = 0 THEN NULL ELSE hits::DOUBLE / requests END AS hit, tok::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE AS cost, err::DOUBLE / n AS er FROM d)
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS window_end, requests, round(lat, 6) AS avg_latency_ms,
  round(hit, 6) AS cache_hit_rate, round(cost, 9) AS daily_cost_usd, round(er, 6) AS error_rate FROM k
WHERE lat > {S.ALERT_LATENCY_MS}::DOUBLE OR hit < {S.ALERT_MIN_HIT_RATE}::DOUBLE OR cost > {S.ALERT_DAILY_COST_USD}::DOUBLE OR er > {S.ALERT_ERROR_RATE}::DOUBLE""")
def sliding_alerts(spark, sf_dir):
    """Alerts over day-long windows that start every hour, late rows aside."""
    windows, _ = ST.run_late_arrivals(spark, sf_dir)
    return windows.filter("alert").drop("alert")


# ------------------------------------------------------------------ operation log as JSON lines
@register("s12_json_log", f"""WITH {O.OP_LOG}
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, operation, duration_ms, success, status_code, 'rag_engine' AS component,
  'tenderlake' AS system, 'req_' || CAST(event_id AS VARCHAR) AS correlation_id, CASE WHEN success THEN 'info' ELSE 'error' END AS level
FROM op_log""")
def json_log(spark, sf_dir):
    """The log written as JSON lines and read through the typed reader."""
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    write_log(fx.op_log(spark, sf_dir), path)
    r = read_log(spark, path)
    return r.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "operation", "duration_ms", "success",
                    "status_code", "component", "system", "correlation_id", "level")


_CASE = "k % 12"
A8_CLASSES = f"""WITH {O.OP_LOG},
e AS (SELECT k % 12 AS c, status_code FROM op_log WHERE NOT success),
f AS (SELECT status_code,
    [{', '.join("'" + x + "'" for x in fx.ERROR_KINDS)}][c + 1] AS kind,
    [{', '.join("'" + x + "'" if x else 'NULL' for x in fx.ERROR_CODES)}][c + 1] AS code,
    [{', '.join("'" + x + "'" if x else 'NULL' for x in fx.ERROR_CONFIG_KEYS)}][c + 1] AS config_key FROM e)
SELECT kind, CASE WHEN kind = 'api' THEN coalesce(
    CASE code {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in S.PROVIDER_ERROR_CODES)} END, 'API_UNKNOWN') ELSE code END AS error_code,
  count(*) AS errors,
  kind = 'api' AND (status_code >= 500 OR status_code = 429) AS is_retryable,
  coalesce(kind = 'api' AND code = 'insufficient_quota', false) AS is_quota_exceeded,
  coalesce(kind = 'api' AND code = 'context_length_exceeded', false) AS is_context_too_long,
  coalesce(kind = 'cache' AND code IN ({', '.join("'" + x + "'" for x in S.RECOVERABLE_CACHE_CODES)}), false) AS is_recoverable,
  coalesce(kind = 'config' AND regexp_matches(lower(config_key), '{'|'.join(S.AUTH_CONFIG_WORDS)}'), false) AS is_authentication_config,
  coalesce(kind = 'vector_store' AND code = 'CONNECTION_FAILED', false) AS is_connection_error,
  coalesce(kind = 'vector_store' AND code = 'COLLECTION_NOT_FOUND', false) AS is_collection_error
FROM f GROUP BY ALL"""


@register("a8_error_classes", A8_CLASSES)
def error_classes(spark, sf_dir):
    """Every class of error, from provider codes, cache codes and
    configuration keys."""
    return RP.error_classes(RP.classify_errors(fx.typed_errors(spark, sf_dir)))
