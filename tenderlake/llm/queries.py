"""Queries opN_<name> of the training-data operators, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.collocations import collocations
from tenderlake.llm.common import read_table
from tenderlake.llm.conversation_repair import repair_conversations
from tenderlake.llm.embedding_dedup import near_duplicates
from tenderlake.llm.language import identify
from tenderlake.llm.mixing import mix_sources
from tenderlake.llm.packing import pack_documents
from tenderlake.llm.quality import score_quality
from tenderlake.llm.sanitise import sanitise
from tenderlake.llm.secrets import scan_documents
from tenderlake.llm.simhash import simhash_classes
from tenderlake.llm.suffix_dedup import remove_repeats
from tenderlake.llm.tokens import count_tokens
from tenderlake.llm.topk import exact_topk
from tenderlake.session import scratch_path


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels not held out."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between all vectors of equal label."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by rank-order profiles."""
    return identify(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base patterns and entropy spans."""
    return scan_documents(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, which come in two batches: the second
    finds the counts that the first has stored.  Every call starts a cache of
    its own, so that its work does not depend on earlier calls."""
    return count_tokens(read_table(spark, sf_dir, "documents"), scratch_path(spark, f"token-cache-{uuid.uuid4().hex}"), batches=2)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at 2 or fewer differing bits."""
    return simhash_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 400-byte repeats cover."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    return exact_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 (repeating) of their sources."""
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, and the terms that disclose it."""
    return sanitise(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two- and three-word phrases of each language over all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by rule, their faults, and the cheapest repair."""
    return repair_conversations(read_table(spark, sf_dir, "conversations"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_source_mixing": op10_source_mixing,
    "op11_pii_sanitisation": op11_pii_sanitisation,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
#: Quotas by listing every quotient; 20, 32, 1000 and 3 are the operator's seed,
#: block, shard and repeat parameters.
OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM w GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
s2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][i % 3 + 1] AS wt, source_size::DOUBLE * 3 AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM s2),
t AS (SELECT source, i, source_size, n_docs, least(cap, coalesce((SELECT lv FROM s3 WHERE cap >= lv * wt ORDER BY cap / wt, i LIMIT 1) * wt, cap)) AS target FROM s3),
n AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS blocks FROM t),
won AS (SELECT i, count(*) AS blocks FROM (
    SELECT i, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i) AS r FROM t, n, unnest(range(n.blocks)) u(k) WHERE target > 0), n
  WHERE r <= n.blocks GROUP BY i),
b AS (SELECT t.*, least(coalesce(won.blocks, 0), CAST(ceil(source_size * 3 / 32.0) AS BIGINT)) AS source_blocks,
        CAST(ceil(n_docs / 1000.0) AS BIGINT) AS n_shards FROM t LEFT JOIN won USING (i)),
d AS (SELECT w.*, b.i, b.source_size, b.target, b.source_blocks, ('0x' || substr(w.h, 1, 12))::BIGINT % b.n_shards AS shard
      FROM w JOIN b ON w.source IS NOT DISTINCT FROM b.source),
sh AS (SELECT i, source, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(source_blocks) AS source_blocks FROM d GROUP BY ALL),
quota AS (SELECT i, shard, count(*) AS q FROM (
    SELECT i, shard, source_blocks, row_number() OVER (PARTITION BY i ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS r
    FROM sh, unnest(range(sh.source_blocks)) u(k) WHERE shard_size > 0) WHERE r <= source_blocks GROUP BY i, shard),
p AS (SELECT sh.i, sh.shard, shard_size, least(coalesce(q, 0) * 32, shard_size * 3) AS words,
        CASE WHEN shard_size > 0 THEN (('0x' || substr(md5('20:' || coalesce(source, 'null') || ':' || shard), 1, 12))::BIGINT % shard_size) // 32 * 32 ELSE 0 END AS b
      FROM sh LEFT JOIN quota USING (i, shard)),
o AS (SELECT d.*, p.shard_size, p.b AS begin_, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS full_,
        CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS rest_,
        coalesce(sum(size) OVER (PARTITION BY d.i, d.shard ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
      FROM d JOIN p USING (i, shard))
SELECT doc_id, size, source_size, target, CAST(full_ * size
    + greatest(0, least(before_ + size, least(begin_ + rest_, shard_size)) - greatest(before_, begin_))
    + greatest(0, least(before_ + size, begin_ + rest_ - shard_size) - before_) AS BIGINT) AS taken FROM o
"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM w) GROUP BY ALL),
f2 AS (SELECT lang, p[1] AS x, p[2] AS y, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM w)
       GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, p[1] AS x, p[2] AS y, p[3] AS z, count(*) AS a
       FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS p FROM w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
held AS (SELECT lang, x, y, max(a) AS m FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, l.f AS l, r.f AS r, 1000000::HUGEINT * f2.a * f2.a // (l.f::HUGEINT * r.f) AS score
  FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.p = f2.x JOIN f1 r ON r.lang = f2.lang AND r.p = f2.y
    LEFT JOIN held h ON h.lang = f2.lang AND h.x = f2.x AND h.y = f2.y WHERE h.m IS NULL OR 100 * h.m < 50 * f2.a
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM (
    SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2 FROM (
      SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.a, l.f AS l1, r.a AS r1, b.a AS l2, z.f AS r2
      FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.p = f3.x JOIN f1 z ON z.lang = f3.lang AND z.p = f3.z
        JOIN f2 b ON b.lang = f3.lang AND b.x = f3.x AND b.y = f3.y JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

#: The operator's parameters: contexts of 60 code points, 3 documents, shares 0.7 and 0.9.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT rid, 0 AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
hit AS (SELECT rid, kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM raw WHERE len(m) > 0),
placed AS (SELECT rid, kind, m[i] AS v, g[i] AS b, g[i + 1] AS n, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s FROM hit),
dig AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg FROM placed),
base AS (SELECT rid, kind, s, s + len(v) AS e, right(b, 60) AS before_, left(n, 60) AS after_, len(b) > 60 AS cut_b, len(n) > 60 AS cut_a,
    kind || ':' || CASE kind WHEN 0 THEN lower(v) WHEN 1 THEN v ELSE dg END AS entity
  FROM dig WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0
    WHEN 2 THEN len(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(len(dg)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(dg[len(dg) - j] AS INT)
      ELSE (CAST(dg[len(dg) - j] AS INT) * 2) % 10 + (CAST(dg[len(dg) - j] AS INT) * 2) // 10 END)) % 10 = 0
    ELSE len(dg) BETWEEN 8 AND 15 END),
often AS (SELECT entity, count(DISTINCT rid) AS d_e FROM base GROUP BY entity HAVING d_e >= 3),
side AS (SELECT rid, entity, d_e, before_ AS c, s - len(before_) AS origin, cut_b AS cut_l, false AS cut_r FROM base JOIN often USING (entity)
  UNION ALL SELECT rid, entity, d_e, after_, e, false, cut_a FROM base JOIN often USING (entity)),
word AS (SELECT rid, entity, d_e, origin, cut_l, cut_r, len(c) AS size, unnest(range(1, len(w) + 1)) AS i, w, g
  FROM (SELECT *, regexp_extract_all(c, '[^\x20\x09-\x0D]+') AS w, string_split_regex(c, '[^\x20\x09-\x0D]+') AS g FROM side)),
word_at AS (SELECT *, w[i] AS word, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x))), 0) AS p FROM word),
near AS (SELECT rid, entity, d_e, lower(regexp_extract(word, '^(["''(\[]*)(\pL{3,})["'')\].,;:!?]*$', 2)) AS term,
    CAST(origin + p + len(regexp_extract(word, '^(["''(\[]*)(\pL{3,})["'')\].,;:!?]*$', 1)) AS BIGINT) AS s, len(regexp_extract(word, '^(["''(\[]*)(\pL{3,})["'')\].,;:!?]*$', 2)) AS n
  FROM word_at WHERE regexp_matches(word, '^(["''(\[]*)(\pL{3,})["'')\].,;:!?]*$') AND NOT (cut_l AND p = 0) AND NOT (cut_r AND p + len(word) = size)),
pairs AS (SELECT term, entity, count(DISTINCT rid) AS d_te, max(d_e) AS d_e FROM near GROUP BY ALL HAVING d_te >= 3),
docs_of AS (SELECT term, count(DISTINCT rid) AS d_t FROM (
    SELECT rid, lower(regexp_extract(unnest(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))), '^(["''(\[]*)(\pL{3,})["'')\].,;:!?]*$', 2)) AS term FROM d) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
told AS (SELECT term, entity, ln(n * d_te / (d_t * d_e)) / ln(n / d_e) AS share FROM pairs JOIN docs_of USING (term), n WHERE d_e < n),
spans AS (SELECT rid, kind, s, e FROM base
  UNION ALL SELECT rid, max(CASE WHEN share >= 0.9 THEN 5 ELSE 4 END), s, s + n FROM near JOIN told USING (term, entity) WHERE share >= 0.7 GROUP BY rid, s, n),
listed AS (SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    count(*) FILTER (kind = 4) AS n_generalise, count(*) FILTER (kind = 5) AS n_remove,
    coalesce(string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < 4), '') AS base,
    string_agg(['email', 'ip', 'card', 'phone', 'generalise', 'remove'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_generalise, 0) AS n_generalise, coalesce(n_remove, 0) AS n_remove
FROM d LEFT JOIN listed USING (rid)
"""

LLM_SQL: dict[str, str] = {"op10_source_mixing": OP10_SQL, "op11_pii_sanitisation": OP11_SQL, "op12_collocations": OP12_SQL}
