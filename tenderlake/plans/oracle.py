"""DuckDB SQL used as an independent oracle for the Spark jobs.

The fixture views are written again in portable SQL (CTE fragments) and
each operator is re-stated in plain SQL.  DuckDB's decimal literals are
cast to DOUBLE; lambdas use the ``lambda x: ...`` form.
"""

from __future__ import annotations

from tenderlake import schemas as S
from tenderlake.sources.fixtures import (ERROR_CODES, ERROR_KINDS, FIXTURE_AMOUNT_FACTORS, FIXTURE_COLLECTIONS,
                                         FIXTURE_ORG_KINDS)


def _lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _dbl_lst(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


def bucket_sql(x: str) -> str:
    parts = [f"WHEN {x} IS NULL THEN '{S.AMOUNT_UNKNOWN}'"]
    for bound, label in S.AMOUNT_BUCKETS:
        if bound is not None:
            parts.append(f"WHEN {x} < {bound} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{S.AMOUNT_BUCKETS[-1][1]}' END"


def srnd(x: str, k: int) -> str:
    """Round like Spark: half-up on the shortest decimal form of the double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10)), {k}) AS DOUBLE)"


def truthy_amount(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> 0)"


ORDER_META = f"""order_meta AS (
  SELECT o.o_orderkey,
    {_lst(FIXTURE_ORG_KINDS)}[c.c_custkey % 6 + 1] || ' ' || n.n_name AS organisme,
    {_lst(S.AO_TYPES)}[o.o_orderkey % 6 + 1] AS type_ao,
    CASE WHEN c.c_custkey % 6 <= 1 THEN 'Territorial' WHEN c.c_custkey % 6 = 2 THEN 'État'
         WHEN c.c_custkey % 6 = 3 THEN 'Hospitalier' WHEN c.c_custkey % 6 = 4 THEN 'Éducation'
         WHEN o.o_orderkey % 2 = 0 THEN 'EPA/EPIC' ELSE 'Défense' END AS secteur,
    CAST(floor(o.o_totalprice * {_dbl_lst(FIXTURE_AMOUNT_FACTORS)}[o.o_orderkey % 5 + 1]) AS BIGINT)
      AS montant_int,
    CAST(o.o_orderdate AS DATE) AS date_publication,
    r.r_name AS zone_geo
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

CORPUS = f"""corpus AS (
  SELECT d.doc_id, {_lst(FIXTURE_COLLECTIONS)}[d.doc_id % 5 + 1] AS collection,
    d.text AS content, m.secteur, m.type_ao, {bucket_sql('m.montant_int')} AS fourchette_montant,
    {_lst(S.DOMAINS)}[d.doc_id % 7 + 1] AS domaine_technique, m.organisme,
    CAST(m.montant_int AS DOUBLE) AS montant, m.date_publication, m.zone_geo
  FROM documents d JOIN order_meta m ON d.doc_id = m.o_orderkey
)"""

TENDER_DOMAINS = f"""tender_domains AS (
  SELECT l_orderkey, list_transform(list_sort(list_distinct(list(CAST(l_partkey % 7 AS INTEGER)))),
         lambda i: {_lst(S.DOMAINS)}[i + 1]) AS technical_domains
  FROM lineitem GROUP BY l_orderkey
)"""

TENDERS = f"""tenders AS (
  SELECT m.o_orderkey AS tender_id, m.type_ao AS ao_type, m.secteur AS sector,
    CASE WHEN m.o_orderkey % 13 = 0 THEN NULL WHEN m.o_orderkey % 17 = 0 THEN 0
         ELSE m.montant_int END AS estimated_amount,
    coalesce(td.technical_domains, []::VARCHAR[]) AS technical_domains,
    CASE WHEN m.o_orderkey % 9 = 0 THEN NULL ELSE m.organisme END AS organisme,
    m.zone_geo AS geographic_scope, m.date_publication AS published,
    CASE WHEN m.o_orderkey % 10 = 0 THEN MAP([]::VARCHAR[], []::INTEGER[])
         ELSE MAP(['prix', 'technique'],
                  [CAST(30 + m.o_orderkey % 41 AS INTEGER),
                   CAST(CASE WHEN m.o_orderkey % 25 = 1 THEN 100 ELSE 70 - m.o_orderkey % 41 END
                        AS INTEGER)]) END AS criteria_weights
  FROM order_meta m LEFT JOIN tender_domains td ON m.o_orderkey = td.l_orderkey
)"""


def hashed_tf_cte(name: str, source: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """``name(id, v)``: hashed term-frequency vectors of ``source``."""
    return f"""{name}_tok AS (
  SELECT {id_col} AS id, unnest(string_split_regex(lower(coalesce({text_col}, '')), '\\s+')) AS w
  FROM {source}
),
{name}_tf AS (
  SELECT id, CAST((('0x' || substr(md5(w), 7, 2))::INTEGER) % {dim} AS BIGINT) AS b, count(*) AS c
  FROM {name}_tok WHERE w <> '' GROUP BY id, b
),
{name} AS (
  SELECT id, list_transform(range({dim}), lambda i: CASE WHEN nrm > 0
           THEN CAST(CAST(coalesce(m[i], 0) AS DOUBLE) / nrm AS FLOAT) ELSE CAST(0.0 AS FLOAT) END) AS v
  FROM (SELECT id, map_from_entries(list({{'k': b, 'v': c}})) AS m,
               sqrt(CAST(sum(c * c) AS DOUBLE)) AS nrm
        FROM {name}_tf GROUP BY id)
)"""


def dist_sql(metric: str, q: str, v: str, dim: int) -> str:
    def red(term: str) -> str:
        return (f"list_reduce(list_transform(range(1, {dim + 1}), lambda i: {term}), "
                f"lambda a, x: a + x)")
    if metric == "l2sq":
        return red(f"({q}[i]::DOUBLE - {v}[i]::DOUBLE) * ({q}[i]::DOUBLE - {v}[i]::DOUBLE)")
    if metric == "cosine":
        dot = red(f"{q}[i]::DOUBLE * {v}[i]::DOUBLE")
        qn = f"sqrt({red(f'{q}[i]::DOUBLE * {q}[i]::DOUBLE')})"
        vn = f"sqrt({red(f'{v}[i]::DOUBLE * {v}[i]::DOUBLE')})"
        return f"(CASE WHEN {qn} * {vn} = 0 THEN 1.0 ELSE 1.0 - {dot} / ({qn} * {vn}) END)"
    raise ValueError(metric)


def enrich_sql(query: str, has_ctx: str) -> str:
    amt = "q.estimated_amount"
    return f"""CASE WHEN NOT {has_ctx} THEN {query} ELSE concat_ws(' - ', {query},
      'appel offres ' || q.ao_type, 'secteur ' || q.sector,
      CASE WHEN {truthy_amount(amt)} THEN 'montant ' || ({bucket_sql(amt)}) END,
      CASE WHEN len(coalesce(q.technical_domains, []::VARCHAR[])) > 0
           THEN 'technologies ' || array_to_string(q.technical_domains, ' ') END,
      CASE WHEN q.organisme IS NOT NULL AND q.organisme <> '' THEN 'organisme ' || q.organisme END) END"""


def relevance_sql(has_ctx: str) -> str:
    kinds = _lst(S.ORG_KINDS)
    amt = "p.estimated_amount"
    return f"""CASE WHEN NOT {has_ctx} THEN p.similarity ELSE least(1.0::DOUBLE, p.similarity + (((((0.0::DOUBLE
      + CASE WHEN p.sector IS NOT NULL AND p.secteur = p.sector THEN {S.BONUS_SECTOR}::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN p.ao_type IS NOT NULL AND p.type_ao = p.ao_type THEN {S.BONUS_TYPE}::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN {truthy_amount(amt)} AND p.fourchette_montant IS NOT NULL AND p.fourchette_montant <> ''
             AND p.fourchette_montant = ({bucket_sql(amt)}) THEN {S.BONUS_AMOUNT}::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN p.q_org IS NOT NULL AND p.q_org <> '' AND p.organisme IS NOT NULL AND p.organisme <> ''
             AND len(list_filter({kinds}, lambda t: contains(lower(p.q_org), t) AND contains(lower(p.organisme), t))) > 0
             THEN {S.BONUS_ORG}::DOUBLE ELSE 0.0::DOUBLE END))) END"""


def search_sql(requests_cte: str, metric: str = "l2sq", dim: int = 64, factor: int = 2,
               with_ctx: bool = True, extra_ctes: str = "", corpus_where: str = "TRUE",
               select: str | None = None, overridden: tuple = ()) -> str:
    """Full search over ``requests(query_id, query, collection, limit, min_similarity,
    has_ctx, ao_type, sector, estimated_amount, technical_domains, organisme)``."""
    amt = "q.estimated_amount"
    conds = []
    if "secteur" not in overridden:
        conds.append("c.secteur = q.sector")
    if "type_ao" not in overridden:
        conds.append("c.type_ao = q.ao_type")
    if "fourchette_montant" not in overridden:
        conds.append(f"(NOT {truthy_amount(amt)} OR c.fourchette_montant = ({bucket_sql(amt)}))")
    if "domaine_technique" not in overridden:
        conds.append("""(len(coalesce(q.technical_domains, []::VARCHAR[])) = 0
             OR list_contains(q.technical_domains, c.domaine_technique))""")
    block = "(NOT q.has_ctx OR (" + (" AND ".join(conds) or "TRUE") + "))"
    return f"""WITH {ORDER_META},
{CORPUS},{extra_ctes}
{requests_cte},
enriched AS (SELECT q.*, {enrich_sql('q.query', 'q.has_ctx')} AS enriched_query FROM requests q
  WHERE NOT (q.query IS NULL OR regexp_matches(q.query, '^\\s*$'))
    AND q."limit" BETWEEN {S.LIMIT_MIN} AND {S.LIMIT_MAX} AND q.min_similarity BETWEEN 0 AND 1),
{hashed_tf_cte('cvec', 'corpus', 'doc_id', 'content', dim)},
{hashed_tf_cte('qvec', 'enriched', 'query_id', 'enriched_query', dim)},
pairs AS (
  SELECT q.query_id, q."limit", q.min_similarity, q.has_ctx, q.ao_type, q.sector,
         q.estimated_amount, q.organisme AS q_org, c.doc_id, c.collection, c.secteur, c.type_ao,
         c.fourchette_montant, c.organisme, {dist_sql(metric, 'qv.v', 'cv.v', dim)} AS distance
  FROM enriched q JOIN (SELECT * FROM corpus WHERE {corpus_where}) c ON q.collection = c.collection AND {block}
  JOIN qvec qv ON qv.id = q.query_id JOIN cvec cv ON cv.id = c.doc_id
),
scored AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - distance) AS similarity FROM pairs),
cands AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS cand_rank
                 FROM scored WHERE similarity >= min_similarity)
  WHERE cand_rank <= {factor} * "limit"
),
rel AS (SELECT p.*, {relevance_sql('p.has_ctx')} AS relevance_score FROM cands p),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
      coalesce(nullif(relevance_score, 0.0), similarity) DESC, distance, doc_id) AS rank FROM rel)
  WHERE rank <= "limit"
)
{select or RESULT_SELECT}"""


RESULT_SELECT = """SELECT query_id, rank, doc_id, collection, round(similarity, 6) AS similarity_score,
  round(relevance_score, 6) AS relevance_score, type_ao AS ao_type, secteur AS sector,
  fourchette_montant AS amount_range, organisme,
  CASE WHEN similarity > 0.8 THEN 'Haute' WHEN similarity > 0.6 THEN 'Moyenne' ELSE 'Faible' END
    AS confidence_level,
  similarity > 0.8 AS is_highly_relevant
FROM ranked"""


DOC_REQUESTS = f"""requests AS (
  SELECT doc_id AS query_id, content AS query, collection, {S.DEFAULT_LIMIT} AS "limit",
    {S.DEFAULT_MIN_SIMILARITY}::DOUBLE AS min_similarity, true AS has_ctx,
    type_ao AS ao_type, secteur AS sector, CAST(montant AS BIGINT) AS estimated_amount,
    [domaine_technique] AS technical_domains, organisme
  FROM corpus
)"""

CONV_REQUESTS = f"""requests AS (
  SELECT conv_id * 1000 + turn AS query_id, text AS query, '{S.DEFAULT_COLLECTION}' AS collection,
    {S.DEFAULT_LIMIT} AS "limit", {S.DEFAULT_MIN_SIMILARITY}::DOUBLE AS min_similarity,
    false AS has_ctx, NULL::VARCHAR AS ao_type, NULL::VARCHAR AS sector,
    NULL::BIGINT AS estimated_amount, NULL::VARCHAR[] AS technical_domains, NULL::VARCHAR AS organisme
  FROM conversations WHERE role = 'user'
)"""


def formalism_sql(t: str, a: str) -> str:
    return (f"CASE WHEN {t} = 'MAPA' THEN 'Minimum' WHEN {t} IN ('Ouvert', 'Restreint') THEN "
            f"CASE WHEN {a} IS NOT NULL AND {a} > 1000000 THEN 'Maximum' ELSE 'Standard' END "
            f"ELSE 'Maximum' END")


def complexity_sql(d: str) -> str:
    return (f"CASE WHEN len({d}) = 0 THEN 'Faible' WHEN len({d}) >= 3 OR "
            f"list_has_any({d}, {_lst(S.COMPLEX_DOMAINS)}) THEN 'Élevée' "
            f"WHEN len({d}) = 2 THEN 'Moyenne' ELSE 'Faible' END")


WEIGHTS_TOTAL = "CAST(coalesce(list_sum(map_values(criteria_weights)), 0) AS BIGINT)"
PRICE_SENS = ("CASE WHEN cardinality(criteria_weights) = 0 THEN 0.5::DOUBLE "
              "ELSE CAST(coalesce(criteria_weights['prix'], 50) AS DOUBLE) / 100.0::DOUBLE END")

PROFILE = f"""WITH {ORDER_META}, {TENDER_DOMAINS}, {TENDERS}
SELECT tender_id, ao_type, sector, estimated_amount, organisme, geographic_scope,
  {bucket_sql('estimated_amount')} AS amount_range,
  {formalism_sql('ao_type', 'estimated_amount')} AS formalism_level,
  round({PRICE_SENS}, 6) AS price_sensitivity,
  {complexity_sql('technical_domains')} AS technical_complexity,
  {WEIGHTS_TOTAL} AS weights_total,
  {WEIGHTS_TOTAL} <= 100 AS weights_valid,
  array_to_string(technical_domains, '|') AS domains
FROM tenders"""

TENDER_REJECTS = f"""WITH {ORDER_META}, {TENDER_DOMAINS}, {TENDERS}
SELECT tender_id, {WEIGHTS_TOTAL} AS weights_total, 'CRITERIA_WEIGHTS_OVER_100' AS reject_reason
FROM tenders WHERE {WEIGHTS_TOTAL} > 100"""

KEYWORDS = f"""WITH {ORDER_META}, {TENDER_DOMAINS}, {TENDERS}
SELECT tender_id,
  array_to_string(list_concat([ao_type, sector], technical_domains, [{bucket_sql('estimated_amount')}],
    CASE WHEN organisme IS NOT NULL AND organisme <> '' THEN [organisme] ELSE []::VARCHAR[] END,
    CASE WHEN geographic_scope IS NOT NULL AND geographic_scope <> '' THEN [geographic_scope]
         ELSE []::VARCHAR[] END), ' | ') AS search_keywords,
  concat_ws(' - ', 'Appel d''offres ' || ao_type || ' secteur ' || sector,
    CASE WHEN {truthy_amount('estimated_amount')} THEN 'montant ' || ({bucket_sql('estimated_amount')}) END,
    CASE WHEN len(technical_domains) > 0 THEN 'domaines techniques: ' || array_to_string(technical_domains, ', ') END,
    CASE WHEN organisme IS NOT NULL AND organisme <> '' THEN 'organisme: ' || organisme END,
    CASE WHEN geographic_scope IS NOT NULL AND geographic_scope <> '' THEN 'périmètre: ' || geographic_scope END)
    AS search_context
FROM tenders"""


# ---------------------------------------------------------------- cache
CACHE_MODEL = "hashed-tf-64"
CACHE_AS_OF = "TIMESTAMP '2024-01-02 12:00:00'"


def cache_key_sql(text: str, model: str = CACHE_MODEL) -> str:
    return f"sha256(trim(regexp_replace({text}, '\\s+', ' ', 'g')) || '|' || '{model}')"


CACHE = f"""cache AS (
  SELECT {cache_key_sql('d.text')} AS cache_key, d.text, '{CACHE_MODEL}' AS model,
    CASE WHEN d.doc_id % 50 = 7 THEN md5(d.text || ' ') ELSE md5(d.text) END AS text_hash,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id % 2880 AS BIGINT)) AS cached_at,
    CAST(256 + strlen(d.text) AS BIGINT) AS size_bytes, 64 AS dim
  FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey
  WHERE o.o_orderdate < TIMESTAMP '1998-01-01'
),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC,
                 text_hash DESC) AS v FROM cache) WHERE v = 1
),
fresh AS (SELECT * FROM latest WHERE {CACHE_AS_OF} < cached_at + INTERVAL 24 HOUR),
texts AS (SELECT doc_id AS pos, text FROM documents),
probed AS (
  SELECT t.pos, t.text, {cache_key_sql('t.text')} AS cache_key,
    CASE WHEN f.cache_key IS NULL THEN 'miss'
         WHEN f.model = '{CACHE_MODEL}' AND f.text_hash = md5(t.text) AND f.dim > 0 THEN 'hit'
         ELSE 'corrupt' END AS status
  FROM texts t LEFT JOIN fresh f ON {cache_key_sql('t.text')} = f.cache_key
  WHERE NOT (t.text IS NULL OR regexp_matches(t.text, '^\\s*$'))
)"""

F12_KEYS = f"""SELECT doc_id, {cache_key_sql('text')} AS cache_key,
  substr({cache_key_sql('text')}, 1, 2) AS key_prefix, md5(text) AS text_hash FROM documents"""

J2_PROBE = f"WITH {CACHE} SELECT pos, cache_key, status FROM probed"

J3_MISSES = f"WITH {CACHE} SELECT DISTINCT cache_key FROM probed WHERE status <> 'hit'"

M6_CORRUPT = f"WITH {CACHE} SELECT DISTINCT cache_key FROM probed WHERE status = 'corrupt'"

E1_EMBED = f"""WITH {CACHE},
{hashed_tf_cte('vec', 'probed', 'pos', 'text', 64)}
SELECT p.pos, p.status, p.status = 'hit' AS from_cache, CAST(len(v.v) AS INTEGER) AS dim,
  round(list_reduce(list_transform(v.v, lambda x: x::DOUBLE), lambda a, x: a + x), 6) AS vsum
FROM probed p JOIN vec v ON v.id = p.pos"""

CACHE_ALL = CACHE.replace("FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey\n  WHERE o.o_orderdate < TIMESTAMP '1998-01-01'",
                          "FROM documents d")

M2_EXPIRE = f"""WITH {CACHE_ALL} SELECT cache_key, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at, size_bytes
FROM cache WHERE {CACHE_AS_OF} < cached_at + INTERVAL 24 HOUR"""

M1_UPSERT = f"""WITH {CACHE},
newe AS (SELECT DISTINCT cache_key, {CACHE_AS_OF} AS cached_at, md5(text) AS text_hash,
           CAST(256 + strlen(text) AS BIGINT) AS size_bytes
         FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY pos) AS r
               FROM probed WHERE status <> 'hit') WHERE r = 1),
u AS (SELECT cache_key, cached_at, text_hash, size_bytes FROM cache UNION ALL SELECT * FROM newe)
SELECT cache_key, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at, size_bytes, text_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, text_hash DESC) AS v FROM u)
WHERE v = 1"""


def m3_evict_sql(max_bytes: int, ratio: float = 0.8) -> str:
    return f"""WITH {CACHE_ALL},
s AS (SELECT cache_key, size_bytes, sum(size_bytes) OVER () AS total,
        coalesce(sum(size_bytes) OVER (ORDER BY cached_at, cache_key
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cache)
SELECT cache_key, size_bytes,
  total > {max_bytes} AND (total - before) > {float(max_bytes) * ratio}::DOUBLE AS evicted FROM s"""


A5_STATS = f"""WITH {CACHE},
st AS (SELECT count(*) AS total_requests, count(*) FILTER (WHERE status = 'hit') AS cache_hits,
         count(*) FILTER (WHERE status <> 'hit') AS cache_misses,
         count(*) FILTER (WHERE status = 'corrupt') AS cache_errors,
         sum(CASE WHEN status = 'hit' THEN len(list_filter(string_split_regex(text, '\\s+'),
             lambda w: w <> ''))::DOUBLE * 1.3::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE
             ELSE 0.0::DOUBLE END) AS sv FROM probed),
sz AS (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS cache_size_bytes, count(*) AS entries FROM cache)
SELECT total_requests, cache_hits, cache_misses, cache_errors,
  round(cache_hits::DOUBLE / total_requests, 6) AS hit_rate, round(sv, 9) AS total_savings_usd,
  cache_size_bytes, entries FROM st, sz"""

M5_CLEAR = f"""WITH {CACHE_ALL} SELECT count(*) AS cleared_entries,
  CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS cleared_bytes FROM cache"""


# ---------------------------------------------------------------- ingestion
INGEST_TS = "TIMESTAMP '2024-03-01 09:00:00'"
BATCHES = f"""batches AS (
  SELECT source || '/' || coll AS batch_id, coll AS collection, text AS content, doc_id AS source_doc, lang
  FROM (SELECT *, {_lst(FIXTURE_COLLECTIONS)}[doc_id % 5 + 1] AS coll FROM documents)
  UNION ALL
  SELECT 'benchmark', 'benchmark', text, item_id, NULL FROM benchmark
),
verdict AS (SELECT batch_id, count(*) AS documents,
  bool_and(NOT (content IS NULL OR regexp_matches(content, '^\\s*$'))) AS accepted FROM batches GROUP BY batch_id),
good AS (SELECT b.* FROM batches b JOIN verdict v ON b.batch_id = v.batch_id WHERE v.accepted),
ided AS (SELECT *, collection || '_' || CAST(epoch_ms({INGEST_TS}) + first_doc AS VARCHAR) || '_' ||
  CAST(row_number() OVER (PARTITION BY batch_id ORDER BY source_doc) - 1 AS VARCHAR) AS doc_id,
  epoch_ms(epoch_ms({INGEST_TS}) + first_doc) AS submitted_at
  FROM (SELECT *, min(source_doc) OVER (PARTITION BY batch_id) AS first_doc FROM good))"""

S2_INGEST = f"""WITH {BATCHES}
SELECT doc_id, collection, batch_id, CAST(length(content) AS INTEGER) AS document_length,
  '{S.ENGINE_VERSION}' AS engine_version, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS added_at,
  lang, NULL::VARCHAR AS meta_collection FROM ided"""

S3_VERDICT = f"WITH {BATCHES} SELECT batch_id, documents, accepted FROM verdict"

S7_SUMMARY = f"""WITH {BATCHES},
g AS (SELECT collection, batch_id, count(*) AS documents_added,
        CAST(sum(length(content)) AS BIGINT) AS total_characters,
        sum(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> ''))) AS words
      FROM ided GROUP BY collection, batch_id)
SELECT collection, batch_id, documents_added, total_characters,
  CAST(floor(words::DOUBLE * 1.3::DOUBLE) AS BIGINT) AS estimated_tokens,
  round(CAST(floor(words::DOUBLE * 1.3::DOUBLE) AS BIGINT)::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE, 9)
    AS estimated_cost_usd
FROM g"""

DEFAULT_COLLECTIONS_SQL = "(VALUES " + ", ".join(
    "('" + n + "', '" + d.replace("'", "''") + "', true)" for n, d in S.DEFAULT_COLLECTIONS) + \
    ") AS dc(name, description, is_default)"

S1_COLLECTIONS = f"""WITH {BATCHES},
dc AS (SELECT * FROM {DEFAULT_COLLECTIONS_SQL}),
new AS (SELECT DISTINCT collection AS name FROM batches WHERE collection NOT IN (SELECT name FROM dc))
SELECT name, description, is_default FROM dc
UNION ALL SELECT name, '' AS description, false AS is_default FROM new"""

S9_COUNTS = f"""WITH {BATCHES},
dc AS (SELECT * FROM {DEFAULT_COLLECTIONS_SQL}),
reg AS (SELECT name, description FROM dc UNION ALL
        SELECT DISTINCT collection, '' FROM batches WHERE collection NOT IN (SELECT name FROM dc)),
cnt AS (SELECT collection, count(*) AS n FROM ided GROUP BY collection)
SELECT r.name, r.description, CAST(coalesce(c.n, 0) AS BIGINT) AS document_count
FROM reg r LEFT JOIN cnt c ON r.name = c.collection"""


# ---------------------------------------------------------------- op log reports
LOG_MODELS = ["text-embedding-3-large", "text-embedding-3-small", "text-embedding-ada-002",
              "custom-embedder"]
OP_LOG = f"""op_log AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type,
    CASE WHEN event_type IN ('view', 'click') THEN 'rag_search' WHEN event_type = 'purchase' THEN 'embedding_call'
         WHEN event_type = 'signup' THEN 'add_documents' ELSE 'failed_operation' END AS operation,
    value AS duration_ms, event_type <> 'error' AS success,
    CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN false END AS cache_hit,
    CASE WHEN event_type = 'purchase' THEN k END AS tokens,
    CASE WHEN event_type = 'signup' THEN k END AS documents,
    CASE WHEN event_type = 'error' THEN CAST([401, 403, 404, 429, 500, 503][k % 6 + 1] AS INTEGER) END AS status_code,
    k, {_lst(LOG_MODELS)}[user_id % 4 + 1] AS model,
    md5(CAST(event_id AS VARCHAR)) AS session_token
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
)"""

A1_STATS = f"""WITH {OP_LOG},
a AS (SELECT count(*) FILTER (WHERE operation = 'rag_search') AS successful_searches,
        count(*) FILTER (WHERE NOT success) AS failed_searches,
        avg(CASE WHEN operation = 'rag_search' THEN duration_ms END) AS av,
        count(*) FILTER (WHERE operation = 'rag_search' AND cache_hit) AS hits,
        coalesce(sum(tokens), 0) AS tok, coalesce(sum(documents), 0) AS docs FROM op_log)
SELECT successful_searches + failed_searches AS total_searches, successful_searches, failed_searches,
  round(coalesce(av, 0.0), 6) AS avg_search_time_ms,
  round(CASE WHEN successful_searches = 0 THEN NULL ELSE hits::DOUBLE / successful_searches END, 6)
    AS cache_hit_rate,
  round(tok::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE, 9) AS total_cost_usd,
  round(tok::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE / greatest(1, successful_searches + failed_searches), 12)
    AS avg_cost_per_search,
  CAST(docs AS BIGINT) AS total_documents_added
FROM a"""

A3_STATS = f"""WITH {OP_LOG},
a AS (SELECT count(*) FILTER (WHERE operation IN ('rag_search', 'embedding_call')) AS total_requests,
        CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens,
        count(*) FILTER (WHERE coalesce(cache_hit, false)) AS cache_hits,
        count(*) FILTER (WHERE operation = 'embedding_call') AS api_calls,
        count(*) FILTER (WHERE NOT success) AS errors,
        avg(CASE WHEN operation = 'embedding_call' THEN duration_ms END) AS lat FROM op_log)
SELECT total_requests, total_tokens,
  round(floor(total_tokens::DOUBLE) / 1000.0::DOUBLE * 0.00013::DOUBLE, 9) AS total_cost_usd,
  cache_hits, api_calls, errors, round(coalesce(lat, 0.0), 6) AS avg_latency_ms,
  round(CASE WHEN total_requests = 0 THEN NULL ELSE cache_hits::DOUBLE / total_requests END, 6) AS cache_hit_rate
FROM a"""

MODELS_SQL = "(VALUES " + ", ".join(f"('{m}', {d}, {p}::DOUBLE)" for m, d, p, _ in S.MODELS) + \
    ") AS mt(model, dimension, price_per_1k)"

A4_COST = f"""WITH {OP_LOG},
g AS (SELECT model, count(*) AS calls, sum(tokens::DOUBLE) AS tok FROM op_log
      WHERE operation = 'embedding_call' GROUP BY model)
SELECT g.model, g.calls, CAST(floor(g.tok) AS BIGINT) AS tokens,
  coalesce(mt.dimension, {S.UNKNOWN_MODEL_DIM}) AS dimension,
  round(CAST(floor(g.tok) AS BIGINT)::DOUBLE / 1000.0::DOUBLE * coalesce(mt.price_per_1k, {S.UNKNOWN_MODEL_PRICE}::DOUBLE), 9)
    AS cost_usd
FROM g LEFT JOIN {MODELS_SQL} ON g.model = mt.model"""

A8_TRIAGE = f"""WITH {OP_LOG}
SELECT status_code, count(*) AS errors,
  status_code >= 500 OR status_code = 429 AS is_retryable,
  status_code IN (401, 403) AS is_authentication_error,
  status_code = 429 AS is_rate_limited,
  CASE WHEN status_code IN (401, 403) THEN 'API_AUTH_ERROR' WHEN status_code = 429 THEN 'API_RATE_LIMIT'
       WHEN status_code >= 500 THEN 'API_SERVER_ERROR' ELSE 'API_CLIENT_ERROR' END AS error_class
FROM op_log WHERE NOT success GROUP BY status_code"""

S13_ERRORS = f"""WITH {OP_LOG},
e AS (SELECT *, {_lst(ERROR_KINDS)}[k % 12 + 1] AS kind, {_lst(ERROR_CODES)}[k % 12 + 1] AS code FROM op_log WHERE NOT success)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE kind WHEN 'api' THEN 'APIError' WHEN 'cache' THEN 'CacheError' WHEN 'config' THEN 'ConfigurationError'
    ELSE 'VectorStoreError' END AS error_type,
  CASE WHEN kind <> 'api' THEN code ELSE CASE code
    {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in S.PROVIDER_ERROR_CODES)} ELSE 'API_UNKNOWN' END END AS error_code, status_code,
  'user_' || CAST(user_id AS VARCHAR) AS correlation_id,
  substr(session_token, 1, 4) || '...' || right(session_token, 4) AS session_token FROM e"""

A9_METRICS = f"""WITH {OP_LOG}
SELECT operation, count(*) AS operations, count(*) FILTER (WHERE success) AS successes,
  round(avg(duration_ms), 6) AS avg_duration_ms,
  round(quantile_cont(duration_ms, 0.5), 6) AS p50_duration_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_duration_ms,
  round(max(duration_ms), 2) AS max_duration_ms
FROM op_log GROUP BY operation"""

W4_RUNNING = f"""WITH {OP_LOG}
SELECT event_id, operation,
  round(sum(CAST(round(duration_ms * 100.0) AS BIGINT)) OVER (PARTITION BY operation ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / (count(*) OVER (PARTITION BY operation
        ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0::DOUBLE), 6) AS running_avg_ms,
  count(*) OVER (PARTITION BY operation ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
FROM op_log"""

S12_LOG = f"""WITH {OP_LOG}
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, operation, duration_ms, success,
  status_code, tokens, documents, cache_hit FROM op_log"""

F15_MASK = f"""WITH {OP_LOG}
SELECT event_id, 'user_' || CAST(user_id AS VARCHAR) AS user,
  CASE WHEN length(session_token) > 8 THEN substr(session_token, 1, 4) || '...' || right(session_token, 4)
       ELSE '***' END AS session_token,
  CASE WHEN k IS NULL THEN NULL WHEN length(CAST(k AS VARCHAR)) > 8
       THEN substr(CAST(k AS VARCHAR), 1, 4) || '...' || right(CAST(k AS VARCHAR), 4) ELSE '***' END AS auth_level,
  event_type AS event
FROM op_log"""

A7_RATIO = f"""WITH {OP_LOG}
SELECT CAST(coalesce(sum(documents), 0) AS BIGINT) AS total_documents_added,
  CAST({len(S.DEFAULT_COLLECTIONS)} AS BIGINT) AS collections,
  round(coalesce(sum(documents), 0)::DOUBLE / greatest(1, {len(S.DEFAULT_COLLECTIONS)}), 6) AS docs_per_collection
FROM op_log"""

F16_TOKENS = """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words,
  round(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::DOUBLE * 1.3::DOUBLE, 6) AS token_estimate,
  len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::DOUBLE * 1.3::DOUBLE > 8191 AS over_token_limit
FROM documents"""

A10_HEALTH = f"""WITH {OP_LOG},
c AS (
  SELECT 'documents' AS component, count(*) > 0 AND count(*) FILTER (WHERE text IS NULL OR regexp_matches(text, '^\\s*$')) = 0 AS healthy FROM documents
  UNION ALL SELECT 'embeddings', count(*) > 0 AND bool_and(len(embedding) = 64) FROM embeddings
  UNION ALL SELECT 'op_log_latency', coalesce(avg(duration_ms), 0) < {S.ALERT_LATENCY_MS}::DOUBLE FROM op_log
  UNION ALL SELECT 'op_log_error_rate', count(*) FILTER (WHERE NOT success)::DOUBLE / greatest(1, count(*)) <= {S.ALERT_ERROR_RATE}::DOUBLE FROM op_log
)
SELECT component, CASE WHEN healthy THEN 'healthy' ELSE 'unhealthy' END AS status FROM c
UNION ALL SELECT 'overall', CASE WHEN bool_and(healthy) THEN 'healthy' ELSE 'unhealthy' END FROM c"""


# ---------------------------------------------------------------- market
AS_OF = "DATE '2001-08-01'"
AWARDS = f"""{ORDER_META}, {TENDER_DOMAINS}, {TENDERS},
bids AS (SELECT l_orderkey, l_suppkey,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DOUBLE) AS price,
    bool_or(l_returnflag <> 'R') AS won FROM lineitem GROUP BY l_orderkey, l_suppkey),
awards AS (SELECT b.l_orderkey * 1000000 + b.l_suppkey AS bid_id, t.tender_id, b.l_suppkey AS supplier,
    b.price, b.won, t.sector, {bucket_sql('t.estimated_amount')} AS amount_range, t.estimated_amount, t.published
  FROM bids b JOIN tenders t ON b.l_orderkey = t.tender_id),
recent12 AS (SELECT * FROM awards WHERE won AND published >= {AS_OF} - INTERVAL 12 MONTH),
bench AS (SELECT sector, amount_range, count(*) AS n,
    {", ".join(f"round(quantile_cont(price, {p}), 6) AS p{int(round(p * 100)):02d}" for p in [0.1, 0.2, 0.3, 0.5, 0.7, 0.9])}
  FROM recent12 GROUP BY sector, amount_range),
competition AS (SELECT sector, amount_range, count(DISTINCT supplier) AS competitors FROM awards
  GROUP BY sector, amount_range),
profiled AS (SELECT *, {bucket_sql('estimated_amount')} AS amount_range,
    {formalism_sql('ao_type', 'estimated_amount')} AS formalism_level,
    {PRICE_SENS} AS price_sensitivity,
    {complexity_sql('technical_domains')} AS technical_complexity FROM tenders)"""

B2_BENCH = f"WITH {AWARDS} SELECT * FROM bench"

B4_COMPETITORS = f"""WITH {AWARDS},
g AS (SELECT sector, amount_range, supplier, count(*) AS bids, count(*) FILTER (WHERE won) AS wins,
        {srnd('CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) / count(*)', 6)} AS avg_price FROM awards
      WHERE published >= {AS_OF} - INTERVAL 18 MONTH GROUP BY sector, amount_range, supplier)
SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY sector, amount_range ORDER BY bids DESC) AS rank FROM g)
WHERE rank <= 5"""

TEMPLATE_USAGE = """usage AS (SELECT p.p_brand AS template, l.l_returnflag <> 'R' AS won,
    l.l_quantity / 50.0::DOUBLE AS score, l.l_partkey, CAST(l.l_linenumber % 5 + 1 AS BIGINT) AS feedback FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

B5_TEMPLATES = f"""WITH {TEMPLATE_USAGE},
g AS (SELECT template, count(*) AS uses, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) AS wr, avg(score) AS sc,
        CAST(sum(feedback) AS DOUBLE) / count(feedback) AS fb FROM usage GROUP BY template)
SELECT template, uses, round(wr, 6) AS win_rate, round(sc, 6) AS avg_score, round(fb, 6) AS avg_feedback,
  row_number() OVER (ORDER BY wr DESC, sc DESC, fb DESC, template) AS rank
FROM g WHERE wr > 0.3::DOUBLE AND uses >= 100"""

B8_WEIGHTING = f"""WITH {TEMPLATE_USAGE},
wr AS (SELECT template, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) AS wr FROM usage GROUP BY template)
SELECT p.p_partkey, p.p_brand AS template,
  round(p.p_retailprice * coalesce(wr.wr, 0.0), 6) AS weighted_score
FROM part p LEFT JOIN wr ON p.p_brand = wr.template"""

B3_POSITION = f"""WITH {AWARDS},
seg AS (SELECT *, quantile_cont(competitors, 0.5) OVER () AS med FROM competition)
SELECT t.tender_id, t.sector, t.amount_range, coalesce(s.competitors, 0) AS competitors,
  CASE WHEN coalesce(t.criteria_weights['prix'], 0) > 60 AND coalesce(s.competitors >= s.med, false) THEN 'aggressive'
       WHEN coalesce(t.criteria_weights['technique'], 0) > 50 AND t.technical_complexity = 'Élevée' THEN 'premium'
       ELSE 'competitive' END AS positioning
FROM profiled t LEFT JOIN seg s ON t.sector = s.sector AND t.amount_range = s.amount_range"""

B6_GONOGO = f"""WITH {AWARDS},
seg AS (SELECT *, max(competitors) OVER () AS mx FROM competition),
sc AS (SELECT t.tender_id,
  25.0::DOUBLE * (CASE WHEN t.estimated_amount IS NOT NULL AND t.estimated_amount <> 0 THEN 1.0 ELSE 0.0 END)
  + 20.0::DOUBLE * (CASE WHEN t.technical_complexity = 'Élevée' THEN 0.5 ELSE 1.0 END)
  + 20.0::DOUBLE * (1.0::DOUBLE - coalesce(s.competitors, 0)::DOUBLE / greatest(coalesce(s.mx, 1), 1))
  + 15.0::DOUBLE * (1.0::DOUBLE - t.price_sensitivity)
  + 10.0::DOUBLE * (CASE WHEN t.organisme IS NOT NULL AND t.organisme <> '' THEN 1.0 ELSE 0.0 END)
  + 10.0::DOUBLE * (CASE WHEN t.formalism_level = 'Maximum' THEN 0.5 ELSE 1.0 END) AS score
  FROM profiled t LEFT JOIN seg s ON t.sector = s.sector AND t.amount_range = s.amount_range)
SELECT tender_id, round(score, 6) AS go_score, CASE WHEN score >= 50.0 THEN 'GO' ELSE 'NO-GO' END AS decision FROM sc"""

B10_CONFIDENCE = f"""WITH {AWARDS}
SELECT sector, amount_range, n, round(n::DOUBLE / (n + 10.0::DOUBLE), 6) AS confidence,
  n::DOUBLE / (n + 10.0::DOUBLE) >= 0.5 AS reliable FROM bench"""

B12_GAPS = f"""WITH {AWARDS}
SELECT a.bid_id, a.tender_id, a.sector, a.amount_range,
  round(a.price - a.estimated_amount, 6) AS gap_to_estimate,
  round(a.price - b.p50, 6) AS gap_to_market,
  round(CASE WHEN b.p50 = 0 THEN NULL ELSE (a.price - b.p50) / b.p50 END, 6) AS gap_to_market_ratio
FROM awards a LEFT JOIN bench b ON a.sector = b.sector AND a.amount_range = b.amount_range WHERE a.won"""

B13_PREDICTION = f"""WITH {AWARDS}
SELECT r.sector, r.amount_range, count(*) AS n,
  {srnd('CAST(sum(CAST(abs(b.p50 - r.price) AS DECIMAL(20,6))) AS DOUBLE) / count(*)', 6)} AS mean_abs_gap
FROM recent12 r JOIN bench b ON r.sector = b.sector AND r.amount_range = b.amount_range
GROUP BY r.sector, r.amount_range"""

B14_FRESHNESS = f"""WITH {ORDER_META}, {CORPUS}
SELECT round(avg(datediff('day', date_publication, {AS_OF})), 6) AS mean_age_days,
  count(DISTINCT (secteur, type_ao)) AS cells,
  round(count(DISTINCT (secteur, type_ao)) / {float(len(S.SECTORS) * len(S.AO_TYPES))}::DOUBLE, 6) AS coverage
FROM corpus"""


def _route_sql() -> str:
    hits = []
    for mode, words in S.MODE_TRIGGERS:
        h = " + ".join(f"(CASE WHEN contains(lower(text), '{w.lower()}') THEN 1 ELSE 0 END)" for w in words)
        hits.append((mode, f"({h})"))
    best = "greatest(" + ", ".join(h for _, h in hits) + ")"
    case = "CASE " + " ".join(f"WHEN {h} = {best} AND {best} > 0 THEN '{m}'" for m, h in hits) + " END"
    cols = ", ".join(f"{h} AS hits_{m.lower()}" for m, h in hits)
    return f"""SELECT conv_id * 1000 + turn AS query_id, {cols}, {case} AS mode
FROM conversations WHERE role = 'user'"""


B11_ROUTE = _route_sql()

B16_TOP_SECTORS = f"""WITH {ORDER_META}, {TENDER_DOMAINS}, {TENDERS},
g AS (SELECT sector, count(*) AS requests FROM tenders GROUP BY sector)
SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY requests DESC) AS rank FROM g) WHERE rank <= 3"""

B16_PER_DAY = f"""WITH {OP_LOG}
SELECT CAST(ts AS DATE) AS day, count(*) AS requests FROM op_log WHERE operation = 'rag_search' GROUP BY 1"""

TENDER_REQUESTS = f"""requests AS (
  SELECT tender_id AS query_id,
    concat_ws(' - ', 'Appel d''offres ' || ao_type || ' secteur ' || sector,
      CASE WHEN {truthy_amount('estimated_amount')} THEN 'montant ' || ({bucket_sql('estimated_amount')}) END,
      CASE WHEN len(technical_domains) > 0 THEN 'domaines techniques: ' || array_to_string(technical_domains, ', ') END,
      CASE WHEN organisme IS NOT NULL AND organisme <> '' THEN 'organisme: ' || organisme END,
      CASE WHEN geographic_scope IS NOT NULL AND geographic_scope <> '' THEN 'périmètre: ' || geographic_scope END)
      AS query,
    '{S.DEFAULT_COLLECTION}' AS collection, {S.DEFAULT_LIMIT} AS "limit",
    {S.DEFAULT_MIN_SIMILARITY}::DOUBLE AS min_similarity, true AS has_ctx,
    ao_type, sector, estimated_amount, technical_domains, organisme
  FROM tenders
)"""

B1_SIMILAR = search_sql(TENDER_REQUESTS, "l2sq", extra_ctes=f"\n{TENDER_DOMAINS},\n{TENDERS},",
                        corpus_where=f"date_publication >= {AS_OF} - INTERVAL 24 MONTH")

CROSS_REQUESTS = f"""requests AS (
  SELECT c.doc_id * 10 + t.i AS query_id, c.content AS query, t.name AS collection, 5 AS "limit", 0.5::DOUBLE AS min_similarity,
    false AS has_ctx, NULL::VARCHAR AS ao_type, NULL::VARCHAR AS sector, NULL::BIGINT AS estimated_amount,
    NULL::VARCHAR[] AS technical_domains, NULL::VARCHAR AS organisme
  FROM corpus c JOIN (SELECT i, {_lst(FIXTURE_COLLECTIONS)}[i + 1] AS name FROM range(5) r(i)) t ON t.name <> c.collection
)"""

B17_CROSS = search_sql(CROSS_REQUESTS, "l2sq")

B15_QUALITY = "WITH res AS (" + search_sql(DOC_REQUESTS, "l2sq") + """)
SELECT collection, count(*) AS results,
  round(avg(CASE WHEN similarity_score > 0.7 THEN 1.0 ELSE 0.0 END), 6) AS relevant_share
FROM res GROUP BY collection"""

B7_RECENCY = "WITH res AS (" + search_sql(DOC_REQUESTS, "l2sq", select="SELECT query_id, rank, doc_id, relevance_score FROM ranked") + f"""), {ORDER_META}, {CORPUS},
b AS (SELECT r.query_id, r.doc_id, r.rank,
        CASE WHEN c.date_publication >= {AS_OF} - INTERVAL 12 MONTH THEN r.relevance_score * 1.5::DOUBLE
             ELSE r.relevance_score END AS bs
      FROM res r JOIN corpus c ON r.doc_id = c.doc_id)
SELECT query_id, doc_id, rank, {srnd('bs', 6)} AS boosted_score,
  row_number() OVER (PARTITION BY query_id ORDER BY bs DESC, rank) AS boosted_rank FROM b"""


# ---------------------------------------------------------------- search variants
CONV_PARAM_REQUESTS = """SELECT conv_id * 1000 + turn AS query_id, text AS query, CAST(turn AS INTEGER) AS "limit",
    (conv_id % 13) / 10.0::DOUBLE AS min_similarity FROM conversations WHERE role = 'user'"""

P1_VALIDATE = f"""SELECT query_id, CASE WHEN query IS NULL OR regexp_matches(query, '^\\s*$') THEN 'EMPTY_QUERY'
    WHEN "limit" IS NULL OR "limit" < {S.LIMIT_MIN} OR "limit" > {S.LIMIT_MAX} THEN 'VALUE_OUT_OF_RANGE:limit'
    WHEN min_similarity IS NULL OR min_similarity < 0 OR min_similarity > 1 THEN 'VALUE_OUT_OF_RANGE:min_similarity'
    END AS reject_reason
FROM ({CONV_PARAM_REQUESTS})"""

P3_ENRICH = f"""WITH {ORDER_META}, {TENDER_DOMAINS}, {TENDERS}, {TENDER_REQUESTS}
SELECT q.query_id, {enrich_sql('q.query', 'q.has_ctx')} AS enriched_query FROM requests q"""

J1_CANDIDATES = search_sql(DOC_REQUESTS, "l2sq", select="""SELECT query_id, doc_id, cand_rank,
  round(similarity, 6) AS similarity, round(distance, 6) AS distance FROM cands""")

OVERRIDE_FILTERS_SQL = "c_type_ao IN ('MAPA', 'Ouvert', 'Restreint') AND fourchette_montant <> '5M+'"
P4_OVERRIDE = search_sql(DOC_REQUESTS, "l2sq",
                         corpus_where="type_ao IN ('MAPA', 'Ouvert', 'Restreint') AND fourchette_montant <> '5M+'",
                         overridden=("type_ao", "fourchette_montant"))

F5_DISPLAY = "WITH res AS (" + search_sql(DOC_REQUESTS, "l2sq", select="""SELECT query_id, rank, doc_id,
  similarity, type_ao FROM ranked""") + f"""), {ORDER_META}, {CORPUS}
SELECT r.query_id, r.rank, r.doc_id,
  '[' || CASE WHEN r.similarity > 0.8 THEN 'Haute' WHEN r.similarity > 0.6 THEN 'Moyenne' ELSE 'Faible' END
  || '] ' || coalesce(r.type_ao, 'AO') || ' - ' || coalesce(c.organisme, 'Non spécifié') || chr(10)
  || 'Montant: ' || coalesce(CAST(c.montant AS VARCHAR), 'Non spécifié') || ' € | Score: '
  || printf('%.2f', {srnd('r.similarity', 2)}) || chr(10)
  || 'Extrait: ' || CASE WHEN length(c.content) > 200 THEN substr(c.content, 1, 200) || '...' ELSE c.content END
  AS display_summary
FROM res r JOIN corpus c ON r.doc_id = c.doc_id"""

A2_SUMMARY = "WITH res AS (" + search_sql(DOC_REQUESTS, "l2sq") + f"""), {ORDER_META}, {CORPUS}, {DOC_REQUESTS},
g AS (SELECT query_id, count(*) AS n,
        CAST(sum(CAST(similarity_score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS av FROM res GROUP BY query_id)
SELECT q.query_id, CAST(coalesce(g.n, 0) AS BIGINT) AS results_count,
  {srnd('coalesce(g.av, 0.0)', 6)} AS avg_similarity,
  CASE WHEN {truthy_amount('q.estimated_amount')} THEN 4 ELSE 3 END AS filters_applied
FROM requests q LEFT JOIN g ON q.query_id = g.query_id"""


# ---------------------------------------------------------------- streaming (same results as batch)
T1_INGEST = f"""WITH {BATCHES.replace("UNION ALL\n  SELECT 'benchmark', 'benchmark', text, item_id, NULL FROM benchmark", "")}
SELECT doc_id, collection, batch_id, CAST(length(content) AS INTEGER) AS document_length,
  '{S.ENGINE_VERSION}' AS engine_version, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS added_at,
  lang, NULL::VARCHAR AS meta_collection FROM ided"""

T2_DEDUP = f"""WITH RECURSIVE e AS (SELECT doc_id, {cache_key_sql('text')} AS cache_key FROM documents),
kept AS (
  SELECT min(doc_id) AS doc_id, cache_key FROM e GROUP BY cache_key
  UNION ALL
  SELECT doc_id, cache_key FROM (
    SELECT e.doc_id, k.cache_key, row_number() OVER (PARTITION BY k.cache_key ORDER BY e.doc_id) AS r
    FROM kept k JOIN e ON e.cache_key = k.cache_key AND e.doc_id >= k.doc_id + 1440) WHERE r = 1
)
SELECT doc_id, cache_key FROM kept"""

T3_KPI = f"""WITH {OP_LOG},
d AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
        count(*) FILTER (WHERE operation = 'rag_search') AS requests,
        sum(CASE WHEN operation = 'rag_search' THEN CAST(round(duration_ms * 100.0) AS BIGINT) END) AS lat_c,
        count(*) FILTER (WHERE cache_hit) AS hits, coalesce(sum(tokens), 0) AS tok,
        count(*) FILTER (WHERE NOT success) AS err, count(*) AS n
      FROM op_log GROUP BY 1),
k AS (SELECT day, requests,
        CASE WHEN requests = 0 THEN NULL ELSE lat_c::DOUBLE / (requests * 100.0::DOUBLE) END AS lat,
        CASE WHEN requests = 0 THEN NULL ELSE hits::DOUBLE / requests END AS hit,
        tok::DOUBLE / 1000.0::DOUBLE * 0.00013::DOUBLE AS cost, err::DOUBLE / n AS er FROM d)
SELECT day, requests, round(lat, 6) AS avg_latency_ms, round(hit, 6) AS cache_hit_rate,
  round(cost, 9) AS daily_cost_usd, round(er, 6) AS error_rate,
  (lat > {S.ALERT_LATENCY_MS}::DOUBLE OR hit < {S.ALERT_MIN_HIT_RATE}::DOUBLE
   OR cost > {S.ALERT_DAILY_COST_USD}::DOUBLE OR er > {S.ALERT_ERROR_RATE}::DOUBLE) AS alert
FROM k"""

T5_SESSIONS = f"""WITH {OP_LOG},
s AS (SELECT user_id, ts FROM op_log WHERE operation = 'rag_search'),
m AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS ns FROM s),
g AS (SELECT *, sum(ns) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS events
FROM g GROUP BY user_id, sid"""


# ---------------------------------------------------------------- checks
E2_ARROW = f"""WITH {hashed_tf_cte('vec', 'documents', 'doc_id', 'text', 64)}
SELECT d.doc_id AS pos, CAST(coalesce(len(v.v), 64) AS INTEGER) AS dim,
  round(coalesce(list_reduce(list_transform(v.v, lambda x: x::DOUBLE), lambda a, x: a + x), 0.0), 6) AS vsum
FROM documents d LEFT JOIN vec v ON v.id = d.doc_id"""

P11_DIMENSION = """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension,
  len(embedding) <> 64 AS dimension_mismatch FROM embeddings"""

P13_OVERSIZE = f"""SELECT {cache_key_sql('text')} AS cache_key, CAST(256 + strlen(text) AS BIGINT) AS size_bytes,
  CAST(256 + strlen(text) AS BIGINT) > {S.CACHE_ENTRY_MAX_BYTES} AS oversize FROM documents"""

P7_SCORES = "WITH res AS (" + search_sql(DOC_REQUESTS, "l2sq") + """)
SELECT count(*) AS results,
  count(*) FILTER (WHERE similarity_score < 0 OR similarity_score > 1 OR relevance_score < 0
                   OR relevance_score > 1) AS out_of_domain FROM res"""


# ---------------------------------------------------------------- B9 hybrid search
CONV_REQUESTS_ANY = CONV_REQUESTS.replace(f"{S.DEFAULT_MIN_SIMILARITY}::DOUBLE AS min_similarity",
                                          "0.0::DOUBLE AS min_similarity")
_WORDS = "list_filter(string_split_regex(lower(coalesce({x}, '')), '\\s+'), lambda w: w <> '')"

B9_HYBRID = "WITH vec AS (" + search_sql(CONV_REQUESTS_ANY, "cosine",
                                        select="SELECT query_id, doc_id, cand_rank FROM cands") + f"""),
{ORDER_META}, {CORPUS}, {CONV_REQUESTS_ANY},
req_terms AS (SELECT DISTINCT query_id, collection, unnest({_WORDS.format(x='query')}) AS term FROM requests),
ccorp AS (SELECT * FROM corpus WHERE collection IN (SELECT collection FROM requests)),
ctoks AS (SELECT doc_id, collection, unnest({_WORDS.format(x='content')}) AS term FROM ccorp),
tf AS (SELECT doc_id, collection, term, count(*) AS tf FROM ctoks GROUP BY doc_id, collection, term),
dl AS (SELECT doc_id, len({_WORDS.format(x='content')}) AS dl FROM ccorp),
stats AS (SELECT c.collection, count(*) AS n_docs, avg(dl.dl) AS avgdl FROM dl JOIN ccorp c ON dl.doc_id = c.doc_id
          GROUP BY c.collection),
tfv AS (SELECT * FROM tf WHERE term IN (SELECT term FROM req_terms)),
dfs AS (SELECT collection, term, count(*) AS df FROM tfv GROUP BY collection, term),
w AS (SELECT tfv.doc_id, tfv.collection, tfv.term,
        ln(1.0::DOUBLE + (s.n_docs - dfs.df + 0.5::DOUBLE) / (dfs.df + 0.5::DOUBLE)) * tfv.tf * 2.2::DOUBLE
        / (tfv.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / s.avgdl)) AS w
      FROM tfv JOIN dfs ON tfv.collection = dfs.collection AND tfv.term = dfs.term
      JOIN dl ON tfv.doc_id = dl.doc_id JOIN stats s ON tfv.collection = s.collection),
sc AS (SELECT r.query_id, w.doc_id, round(sum(w.w), 9) AS bm25 FROM req_terms r
       JOIN w ON r.term = w.term AND r.collection = w.collection GROUP BY r.query_id, w.doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS bm25_rank
                      FROM sc WHERE bm25 > 0) WHERE bm25_rank <= 10),
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + bm25_rank) AS s FROM bm
      UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + cand_rank) FROM vec),
g AS (SELECT query_id, doc_id, sum(s) AS rrf FROM u GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, round(rrf, 9) AS rrf_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM g) WHERE rank <= 5"""


S6_S8_APPEND_READ = f"""WITH {BATCHES}
SELECT doc_id, collection, CAST(length(content) AS INTEGER) AS document_length FROM ided
WHERE collection = 'historique_ao'"""

P2_BLANK = """SELECT conv_id, count(*) AS texts,
  count(*) FILTER (WHERE text IS NULL OR regexp_matches(text, '^\\s*$')) > 0 AS rejected
FROM conversations GROUP BY conv_id"""


# ---------------------------------------------------------------- precomputed vectors (E3 a)
VEC_SEARCH = f"""WITH {ORDER_META}, {CORPUS},
cv AS (SELECT c.*, e.embedding AS v FROM corpus c JOIN embeddings e ON e.vec_id = c.doc_id),
requests AS (SELECT e.vec_id AS query_id, c.collection, e.embedding AS qv FROM embeddings e
             JOIN corpus c ON c.doc_id = e.vec_id),
pairs AS (SELECT q.query_id, c.doc_id, c.collection, c.secteur, c.type_ao, c.fourchette_montant, c.organisme,
            {dist_sql('cosine', 'q.qv', 'c.v', 64)} AS distance
          FROM requests q JOIN cv c ON q.collection = c.collection),
scored AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - distance) AS similarity FROM pairs),
cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS cand_rank
                         FROM scored) WHERE cand_rank <= 10),
ranked AS (SELECT *, similarity AS relevance_score, row_number() OVER (PARTITION BY query_id ORDER BY
             coalesce(nullif(similarity, 0.0), similarity) DESC, distance, doc_id) AS rank FROM cands)
SELECT query_id, rank, doc_id, collection, round(similarity, 6) AS similarity_score,
  round(relevance_score, 6) AS relevance_score, type_ao AS ao_type, secteur AS sector,
  fourchette_montant AS amount_range, organisme,
  CASE WHEN similarity > 0.8 THEN 'Haute' WHEN similarity > 0.6 THEN 'Moyenne' ELSE 'Faible' END AS confidence_level,
  similarity > 0.8 AS is_highly_relevant
FROM ranked WHERE rank <= 5"""

def _signatures(name: str, source: str, dim: int = 64, bands: int = 16, bits: int = 6) -> str:
    return f"""(SELECT id, b, string_agg(bit, '' ORDER BY t) AS sig FROM (
    SELECT x.id, p.b, p.t, CASE WHEN sum(p.s * CAST(floor(x.v[p.i + 1]::DOUBLE * 1048576.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) >= 0
             THEN '1' ELSE '0' END AS bit
    FROM {source} x, (SELECT b, t, i, CASE WHEN substr(md5(b || ':' || t || ':' || i), 1, 1) < '8' THEN 1 ELSE -1 END AS s
                      FROM range({bands}) rb(b), range({bits}) rt(t), range({dim}) ri(i)) p GROUP BY ALL) GROUP BY id, b) {name}"""


_APPROX = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM (
    SELECT pr.query_id, pr.doc_id, {dist_sql('l2sq', 'qv.v', 'cv.v', 64)} AS distance FROM (
      SELECT DISTINCT q.query_id, c.doc_id FROM enriched q JOIN {_signatures('qs', 'qvec')} ON qs.id = q.query_id
        JOIN {_signatures('cs', 'cvec')} ON cs.b = qs.b AND cs.sig = qs.sig
        JOIN corpus c ON c.doc_id = cs.id AND c.collection = q.collection) pr
      JOIN qvec qv ON qv.id = pr.query_id JOIN cvec cv ON cv.id = pr.doc_id)
    WHERE greatest(0.0::DOUBLE, 1.0::DOUBLE - distance) >= 0.5::DOUBLE) WHERE rank <= 10)"""

J6_APPROX = search_sql(DOC_REQUESTS, "l2sq", select=f"""SELECT query_id, doc_id, rank,
  round(greatest(0.0::DOUBLE, 1.0::DOUBLE - distance), 6) AS similarity FROM {_APPROX}""")

J6_RECALL = search_sql(DOC_REQUESTS, "l2sq", select=f"""SELECT count(*) AS exact_pairs, count(a.doc_id) AS found,
  round(count(a.doc_id)::DOUBLE / count(*), 6) AS recall FROM (
    SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS r FROM (
      SELECT q.query_id, c.doc_id, q.min_similarity, {dist_sql('l2sq', 'qv.v', 'cv.v', 64)} AS distance
      FROM enriched q JOIN corpus c ON c.collection = q.collection JOIN qvec qv ON qv.id = q.query_id JOIN cvec cv ON cv.id = c.doc_id)
      WHERE greatest(0.0::DOUBLE, 1.0::DOUBLE - distance) >= min_similarity) WHERE r <= {2 * S.DEFAULT_LIMIT}) e
  LEFT JOIN {_APPROX} a ON a.query_id = e.query_id AND a.doc_id = e.doc_id""")

J6_INDEX_RECALL = search_sql(DOC_REQUESTS, "l2sq", select=f"""SELECT (SELECT count(*) FROM corpus) AS indexed,
  count(*) AS exact_pairs, TRUE AS recall_reached FROM (
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS r FROM (
      SELECT q.query_id, c.doc_id, q.min_similarity, {dist_sql('l2sq', 'qv.v', 'cv.v', 64)} AS distance
      FROM enriched q JOIN corpus c ON c.collection = q.collection JOIN qvec qv ON qv.id = q.query_id JOIN cvec cv ON cv.id = c.doc_id)
      WHERE greatest(0.0::DOUBLE, 1.0::DOUBLE - distance) >= min_similarity) WHERE r <= {2 * S.DEFAULT_LIMIT}) e""")

T4_ALERTS = search_sql(CONV_REQUESTS.replace(f"{S.DEFAULT_MIN_SIMILARITY}::DOUBLE AS min_similarity", "0.8::DOUBLE AS min_similarity"),
                       "cosine", select="""SELECT query_id, doc_id, round(similarity, 6) AS similarity
FROM scored WHERE similarity >= min_similarity""")
