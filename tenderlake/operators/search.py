"""Batch contextual search: many requests against a collection-partitioned corpus.

Plan:

    requests ─ validate (P1) ─ enrich text (P3) ─ embed ─┐
    corpus ─ dimension check (P11) ─ user filters (P4/P5, pushed to the scan)
        ─ blocking key per request shape ─ lanes of requests (knn_block) ─
        per-request top 2·limit, ranked (W1) ─ contextual relevance
        (F2) ─ rerank top limit (W2) ─ result columns (P8, F3, F4)

Blocking: a request filters on ``collection`` and, with a context, on
``secteur``/``type_ao`` (and ``fourchette_montant`` when the amount is
set).  Each corpus row is emitted once per request *shape* that is present (no
context / context / context + amount) with the matching key, so every request
finds its candidates through an equi-join.  ``domaine_technique IN (...)`` is
tested inside the lanes.  Requests of a key, hot or not, are dealt to lanes of
bounded size that its documents stream past; request/document pairs are never rows.

``kernel="join"`` states the same search as one DataFrame join (every pair a
row); tests hold the two against each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.predicates import filter_keys, filter_predicate
from tenderlake.functions.profile import amount_bucket, amount_present, enrich_query
from tenderlake.functions.text import is_blank
from tenderlake.functions.vectors import distance
from tenderlake.operators.knn_block import CORPUS_BLOCK, REQUEST_BLOCK, block_candidates
from tenderlake.operators.providers import HashedTF, Provider
from tenderlake.session import written

CTX_KEYS = ("secteur", "type_ao", "fourchette_montant")
RESULT_COLUMNS = ["query_id", "rank", "doc_id", "collection", "similarity_score",
                  "relevance_score", "ao_type", "sector", "amount_range", "organisme",
                  "confidence_level", "is_highly_relevant"]


@dataclass
class SearchOptions:
    metric: str = "l2sq"
    candidate_factor: int = S.CANDIDATE_FACTOR
    filters: dict | None = None
    carry: list | None = None         # extra corpus columns to keep in the candidates
    kernel: str = "block"             # "block" (matrix products of lanes) or "join"
    request_block: int = REQUEST_BLOCK
    corpus_block: int = CORPUS_BLOCK
    stored: bool = False              # the corpus is a stored table that is cheap to read again


# ---------------------------------------------------------------- P1
def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (NULL when valid): blank query, limit out of
    [1, 100], min_similarity out of [0, 1]."""
    lim = F.col("limit")
    ms = F.col("min_similarity")
    reason = (F.when(is_blank(F.col("query")), F.lit("EMPTY_QUERY"))
              .when(lim.isNull() | (lim < S.LIMIT_MIN) | (lim > S.LIMIT_MAX),
                    F.lit("VALUE_OUT_OF_RANGE:limit"))
              .when(ms.isNull() | (ms < 0.0) | (ms > 1.0),
                    F.lit("VALUE_OUT_OF_RANGE:min_similarity")))
    return requests.withColumn("reject_reason", reason)


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill missing request columns with the documented defaults."""
    cols = set(requests.columns)
    out = requests
    if "collection" not in cols:
        out = out.withColumn("collection", F.lit(S.DEFAULT_COLLECTION))
    if "limit" not in cols:
        out = out.withColumn("limit", F.lit(S.DEFAULT_LIMIT))
    if "min_similarity" not in cols:
        out = out.withColumn("min_similarity", F.lit(S.DEFAULT_MIN_SIMILARITY))
    if "ctx" not in cols:
        out = out.withColumn("ctx", F.lit(None).cast(S.CONTEXT_TYPE))
    return out


# ---------------------------------------------------------------- blocking
def _shape_keys(overridden: set[str]) -> dict[int, list[str]]:
    """Context keys used as join keys per request shape."""
    base = [k for k in ("secteur", "type_ao") if k not in overridden]
    amt = base + ([] if "fourchette_montant" in overridden else ["fourchette_montant"])
    return {0: [], 1: base, 2: amt}


def _request_blocking(q: DataFrame, overridden: set[str]) -> DataFrame:
    ctx = F.col("ctx")
    shape = (F.when(ctx.isNull(), F.lit(0))
             .when(amount_present(ctx["estimated_amount"]), F.lit(2)).otherwise(F.lit(1)))
    keys = _shape_keys(overridden)
    value = {"secteur": ctx["sector"], "type_ao": ctx["ao_type"],
             "fourchette_montant": amount_bucket(ctx["estimated_amount"])}
    q = q.withColumn("_shape", shape)
    for k in CTX_KEYS:
        expr = F.lit("")
        for s in (2, 1):
            if k in keys[s]:
                expr = F.when(F.col("_shape") == s, value[k]).otherwise(expr)
        q = q.withColumn(f"_k_{k}", expr)
    return q


def _corpus_blocking(c: DataFrame, overridden: set[str], shapes=(0, 1, 2)) -> DataFrame:
    """One row per corpus row and request shape present (at most three)."""
    keys = _shape_keys(overridden)
    variants = []
    for s in shapes:
        variants.append(F.struct(
            F.lit(s).alias("_shape"),
            *[(F.col(k) if k in keys[s] else F.lit("")).alias(f"_k_{k}") for k in CTX_KEYS]))
    return c.withColumn("_b", F.explode(F.array(*variants))).select("*", "_b.*").drop("_b")


def wrong_dimension(corpus: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or has not ``dim`` components; the
    search leaves them out."""
    return corpus.filter(F.col(vec_col).isNull() | (F.size(vec_col) != dim))


def _key(side: list[str]):
    """One string of the blocking values; NULL when any of them is."""
    return F.concat(*[x for c in side for x in (F.col(c).cast("string"), F.lit("\x1f"))])


# ---------------------------------------------------------------- J1 + W1
def knn_candidates(requests: DataFrame, corpus: DataFrame, dim: int,
                   opts: SearchOptions | None = None,
                   vec_col: str = "q_vec") -> DataFrame:
    """Per request, the ``candidate_factor * limit`` nearest corpus rows with
    ``similarity >= min_similarity``, inside the request's collection and
    context filter.

    requests: query_id, collection, limit, min_similarity, ctx, <vec_col>
    corpus:   doc_id, collection, embedding, secteur, type_ao,
              fourchette_montant, domaine_technique, organisme, ...

    Vectors are computed once: the requests and, unless ``opts.stored``, the
    columns of the corpus that the ranking needs are written to the shared
    folder first; sizes of keys, checks and the join read those tables.
    """
    opts = opts or SearchOptions()
    overridden = filter_keys(opts.filters)
    requests = written(requests.select("query_id", "collection", "limit", "min_similarity", "ctx", vec_col), "search-requests")
    # one small aggregate: the largest limit and the request shapes present
    row = requests.agg(F.max("limit").alias("m"), F.bool_or(F.col("ctx").isNull()).alias("plain"),
                       F.bool_or(F.col("ctx").isNotNull()).alias("ctx")).first()
    max_limit = int(row["m"] or 1)
    if max_limit > S.LIMIT_MAX:
        raise ValueError(f"limit {max_limit} is above {S.LIMIT_MAX}: validate the requests first")
    k = opts.candidate_factor * max_limit
    shapes = ([0] if row["plain"] else []) + ([1, 2] if row["ctx"] else [])

    c = corpus.filter(filter_predicate(opts.filters)) if opts.filters else corpus
    # Only the columns the ranking needs travel with the vectors.
    keep = ["doc_id", "collection", "embedding", "secteur", "type_ao", "fourchette_montant",
            "domaine_technique", "organisme"] + [x for x in (opts.carry or []) if x in corpus.columns]
    c = c.select(*keep)
    if not opts.stored:
        c = written(c, "search-corpus")
    c = c.filter(F.size("embedding") == dim)
    c = _corpus_blocking(c, overridden, shapes or [0])
    q = requests.select("query_id", "collection", "limit", "min_similarity", "ctx", F.col(vec_col).alias("_qv"))
    q = _request_blocking(q, overridden).withColumnRenamed("collection", "_q_collection")
    domain_filter = "domaine_technique" not in overridden
    keys = [f"_k_{x}" for x in CTX_KEYS]
    if opts.kernel == "join":
        cands = _pair_join(q, c, dim, opts.metric, keys, domain_filter)
    else:
        cc = c.withColumn("_key", _key(["_shape", "collection", *keys])).select("_key", *keep)
        qq = q.withColumn("_key", _key(["_shape", "_q_collection", *keys])).select(
            "_key", "query_id", "limit", "min_similarity", "_qv",
            *([F.col("ctx.technical_domains").alias("_doms")] if domain_filter else []))
        cands = block_candidates(qq, cc, dim, opts.metric, k, domain_filter, opts.request_block, opts.corpus_block)
        # a request's rows come ranked, unless its id stands under several keys
        keys_of = qq.groupBy("query_id").agg((F.count("_key") > 0).alias("any"), (F.min("_key") != F.max("_key")).alias("several"))
        if keys_of.filter(F.col("any") & F.col("several")).isEmpty():
            cands = (cands.withColumn("similarity", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")))
                     .filter(F.col("cand_rank") <= F.col("limit") * opts.candidate_factor))
        else:
            cands = _top(cands.drop("cand_rank"), k, opts.candidate_factor)
        # the context of a request comes back to its few candidates
        ctx = requests.select(F.col("query_id").alias("_qid"), "ctx")
        return cands.join(ctx, cands["query_id"] == ctx["_qid"]).drop("_qid") if row["ctx"] \
            else cands.withColumn("ctx", F.lit(None).cast(S.CONTEXT_TYPE))
    return _top(cands, k, opts.candidate_factor)


def _top(cands: DataFrame, k: int, factor: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("doc_id").asc())
    return (cands.withColumn("similarity", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")))
            .withColumn("cand_rank", F.row_number().over(w))
            .filter(F.col("cand_rank") <= F.lit(k)).filter(F.col("cand_rank") <= F.col("limit") * factor))


def _pair_join(q: DataFrame, c: DataFrame, dim: int, metric: str, keys: list[str], domain_filter: bool) -> DataFrame:
    """The search as one equi-join: a row for every pair of a blocking key."""
    on = [c["_shape"] == q["_shape"], c["collection"] == q["_q_collection"]] + [c[k] == q[k] for k in keys]
    pairs = c.join(q, on)
    if domain_filter:
        doms = F.coalesce(F.col("ctx.technical_domains"), F.array().cast("array<string>"))
        pairs = pairs.filter((F.col("ctx").isNull()) | (F.size(doms) == 0)
                             | F.array_contains(doms, F.col("domaine_technique")))
    pairs = pairs.withColumn("distance", distance(metric, F.col("_qv"), F.col("embedding"), dim))
    # P6 before the top-k: similarity is non-increasing in distance.
    pairs = pairs.filter(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")) >= F.col("min_similarity"))
    return pairs.drop("embedding", *[x for x in pairs.columns if x.startswith("_")])


# ---------------------------------------------------------------- F2
def contextual_relevance(sim: Column, ctx: Column) -> Column:
    """min(1, sim + bonus); bonuses added in a fixed order; sim without context."""
    org_q = F.lower(ctx["organisme"])
    org_d = F.lower(F.col("organisme"))
    kinds = F.array(*[F.lit(k) for k in S.ORG_KINDS])
    b_sector = F.when(ctx["sector"].isNotNull() & (F.col("secteur") == ctx["sector"]),
                      F.lit(S.BONUS_SECTOR)).otherwise(F.lit(0.0))
    b_type = F.when(ctx["ao_type"].isNotNull() & (F.col("type_ao") == ctx["ao_type"]),
                    F.lit(S.BONUS_TYPE)).otherwise(F.lit(0.0))
    fm = F.col("fourchette_montant")
    b_amount = F.when(amount_present(ctx["estimated_amount"]) & fm.isNotNull() & (fm != "")
                      & (fm == amount_bucket(ctx["estimated_amount"])),
                      F.lit(S.BONUS_AMOUNT)).otherwise(F.lit(0.0))
    b_org = F.when(org_q.isNotNull() & (org_q != "") & org_d.isNotNull() & (org_d != "")
                   & F.exists(kinds, lambda t: F.contains(org_q, t) & F.contains(org_d, t)),
                   F.lit(S.BONUS_ORG)).otherwise(F.lit(0.0))
    bonus = ((F.lit(0.0) + b_sector) + b_type) + b_amount + b_org
    return F.when(ctx.isNull(), sim).otherwise(F.least(F.lit(1.0), sim + bonus))


def confidence_level(sim: Column) -> Column:
    return (F.when(sim > 0.8, F.lit(S.CONF_HIGH)).when(sim > 0.6, F.lit(S.CONF_MID))
            .otherwise(F.lit(S.CONF_LOW)))


def display_summary(sim: Column, ao_type: Column, organisme: Column, montant: Column,
                    content: Column, max_len: int = 200) -> Column:
    """Three-line display text (score printed with two decimals)."""
    preview = F.when(F.length(content) > max_len,
                     F.concat(F.substring(content, 1, max_len), F.lit("..."))).otherwise(content)
    return F.concat(
        F.lit("["), confidence_level(sim), F.lit("] "), F.coalesce(ao_type, F.lit("AO")),
        F.lit(" - "), F.coalesce(organisme, F.lit(S.AMOUNT_UNKNOWN)), F.lit("\n"),
        F.lit("Montant: "), F.coalesce(montant.cast("string"), F.lit(S.AMOUNT_UNKNOWN)),
        F.lit(" € | Score: "), F.format_string("%.2f", sim), F.lit("\n"),
        F.lit("Extrait: "), preview)


# ---------------------------------------------------------------- W2
def rerank(cands: DataFrame) -> DataFrame:
    """Keep ``limit`` rows per request ordered by relevance (desc); ties keep
    candidate order (distance, doc_id)."""
    rel = contextual_relevance(F.col("similarity"), F.col("ctx"))
    out = cands.withColumn("relevance_score", rel)
    key = F.coalesce(F.nullif(F.col("relevance_score"), F.lit(0.0)), F.col("similarity"))
    w = Window.partitionBy("query_id").orderBy(key.desc(), F.col("distance").asc(),
                                               F.col("doc_id").asc())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("limit"))


def result_columns(ranked: DataFrame) -> DataFrame:
    sim = F.col("similarity")
    return ranked.select(
        "query_id", "rank", "doc_id", "collection",
        F.round(sim, 6).alias("similarity_score"),
        F.round(F.col("relevance_score"), 6).alias("relevance_score"),
        F.col("type_ao").alias("ao_type"),
        F.col("secteur").alias("sector"),
        F.col("fourchette_montant").alias("amount_range"),
        "organisme",
        confidence_level(sim).alias("confidence_level"),
        (sim > 0.8).alias("is_highly_relevant"),
    )


def prepare_requests(requests: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(valid requests with query vectors, rejected requests)."""
    v = validate_requests(with_defaults(requests))
    rejected = v.filter(F.col("reject_reason").isNotNull())
    good = v.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    good = good.withColumn("enriched_query", enrich_query(F.col("query"), F.col("ctx")))
    good = provider.embed(good, "enriched_query", "q_vec")
    return good, rejected


def search(requests: DataFrame, corpus: DataFrame, provider: Provider | None = None,
           opts: SearchOptions | None = None) -> DataFrame:
    """Ranked results for every valid request (rejected ones are dropped;
    use ``validate_requests`` to get them)."""
    provider = provider or HashedTF()
    good, _ = prepare_requests(requests, provider)
    cands = knn_candidates(good, corpus, provider.dim, opts)
    return result_columns(rerank(cands))


METADATA = ["secteur", "type_ao", "fourchette_montant", "domaine_technique", "organisme", "zone_geo"]


def attach_documents(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Results with ``content`` and ``metadata`` (a struct) of their
    documents, joined by id after the top-k (only ids and texts of the corpus
    are read)."""
    docs = corpus.select(F.col("doc_id").alias("_id"), "content", F.struct(*[c for c in METADATA if c in corpus.columns]).alias("metadata"))
    return results.join(docs, results["doc_id"] == docs["_id"]).drop("_id")


def score_violations(results: DataFrame) -> DataFrame:
    """Results whose similarity or relevance lies outside [0, 1]."""
    ok = F.col("similarity_score").between(0.0, 1.0) & F.col("relevance_score").between(0.0, 1.0)
    return results.filter(~F.coalesce(ok, F.lit(False)))


def applied_filters(ctx: Column, filters: dict | None = None) -> Column:
    """A2: number of filter keys that a request's search applies: its context
    keys (those the user filters replace not counted) and the user's own."""
    own = filter_keys(filters)
    size = F.size(F.coalesce(ctx["technical_domains"], F.array().cast("array<string>")))
    context = {"type_ao": F.lit(True), "secteur": F.lit(True),
               "fourchette_montant": amount_present(ctx["estimated_amount"]), "domaine_technique": size > 0}
    n = F.lit(len(filters or {}))
    for key, present in context.items():
        if key not in own:
            n = n + F.when(ctx.isNotNull() & F.coalesce(present, F.lit(False)), 1).otherwise(0)
    return n


def export_results(results: DataFrame, path: str | None = None) -> DataFrame:
    """Results with their derived fields as one JSON document per row;
    written as compressed JSON lines when ``path`` is given."""
    out = results.select("query_id", "rank", F.to_json(F.struct(*[F.col(c) for c in results.columns]))
                         .alias("json"))
    if path:
        out.select("json").write.mode("overwrite").option("compression", "gzip").text(path)
    return out


def matches_above(requests: DataFrame, corpus: DataFrame, dim: int, metric: str = "cosine", vec_col: str = "q_vec") -> DataFrame:
    """Every (request, document) of a collection whose similarity reaches the
    request's min_similarity, however many: (query_id, doc_id, similarity)."""
    q = requests.select("query_id", F.col("collection").alias("_key"), F.col("limit"), "min_similarity", F.col(vec_col).alias("_qv"))
    c = written(corpus.select("doc_id", F.col("collection").alias("_key"), "embedding"), "alert-corpus").filter(F.size("embedding") == dim)
    hits = block_candidates(q, c, dim, metric, 1 << 31, False)
    return hits.select("query_id", "doc_id", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")).alias("similarity"))


def search_vectors(requests: DataFrame, corpus: DataFrame, dim: int,
                   opts: SearchOptions | None = None, vec_col: str = "q_vec") -> DataFrame:
    """Search with request vectors given directly (no text to enrich or
    embed): limit and min_similarity are validated, then the same
    candidates, rerank and result columns as ``search``."""
    r = with_defaults(requests)
    lim, ms = F.col("limit"), F.col("min_similarity")
    r = r.filter(lim.between(S.LIMIT_MIN, S.LIMIT_MAX) & ms.between(0.0, 1.0)
                 & F.col(vec_col).isNotNull())
    return result_columns(rerank(knn_candidates(r, corpus, dim, opts, vec_col)))
