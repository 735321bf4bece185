import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm.language import Grams, identify, rank_document
from tenderlake.llm.quality import BUCKETS, NONZERO, Pieces, _words, fit, index_vectors, pooled, probability, score_quality, context_vectors

SF = "/root/testdata/sf0.01"


def remainder(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.fixture(scope="module")
def scored(spark):
    return score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()


def test_quality_on_held_out_documents(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in scored if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95
    assert np.mean([p == y for _, y, p in held]) > 0.9


def test_held_out_labels_are_not_read(spark, scored):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = score_quality(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), other).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in scored}


def test_quality_edges(spark, edge_docs, no_docs):
    schema = "doc_id bigint, quality int, toxic int, score string"
    some = spark.createDataFrame([(1, 1, 0, "a"), (9, 0, 0, "a"), (9, 0, 0, "a"), (6, 1, 0, "b"), (10, 0, 1, "b"), (7, 1, 0, "c"), (7, 0, 0, "c"),
                                  (None, 1, 0, "d"), (3, None, 0, "d"), (5, 7, 0, "e")], schema)
    for labels in (some, some.filter("quality = 1"), some.filter(F.lit(False))):
        out = score_quality(edge_docs, labels).collect()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in edge_docs.collect())
        assert all(0 <= r.score <= 1 for r in out)
        assert all(r.held_out == (r.doc_id is not None and remainder(r.doc_id, 5) == 0) for r in out)
    assert {r.score for r in out} == {0.5}
    assert score_quality(no_docs, some).collect() == []
    assert score_quality(edge_docs, some, row=True).select("row.*").columns == edge_docs.columns


def test_context_vectors_are_sums_over_neighbours(spark):
    texts = ["a b c a", "b", None, "c c A! b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vectors, counts = context_vectors(df, "text", BUCKETS, 48, 5)
    place, sign = index_vectors(BUCKETS, 48, NONZERO, 5)
    want, seen = np.zeros((BUCKETS, 48)), Counter()
    for t in texts:
        ids, _ = Pieces().rows([(t or "").encode()])
        seen.update(ids.tolist())
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    want[a, place[ids[j]]] += sign[ids[j]]
    assert np.array_equal(vectors, want.astype(np.float32))
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == seen


def test_index_vectors_tell_buckets_apart():
    place, sign = index_vectors()
    vectors = np.zeros((BUCKETS, 48), np.int8)
    np.put_along_axis(vectors, place, sign.astype(np.int8), axis=1)
    assert len(np.unique(vectors, axis=0)) > 0.99 * BUCKETS


def test_whole_pieces_are_read(spark):
    """Texts without spaces that differ only after byte 4096, or after 64 words."""
    for start, a, b in (("\u6f22\u5b57" * 1000, "\u732b\u72ac" * 50, "\u9ce5\u9b5a" * 50), ("x" * 5000, "cat" * 50, "dog" * 50), ("key:1," * 900, "cat,cow", "dog,hen"),
                        ("un\u00a0mot\u00a0" * 700, "chat\u00a0noir", "chien\u00a0roux"), ("a,b;" * 40, "cat", "dog")):
        x, y = (Pieces().rows([(start + end).encode()])[0] for end in (a, b))
        assert not np.array_equal(x, y)
        assert len(x) > len((start + a).encode()) // 9  # grams cover the runs
        va, vb = (context_vectors(spark.createDataFrame([(start + end,)], "text string"), "text", BUCKETS, 48, 5) for end in (a, b))
        assert not np.array_equal(va[0], vb[0]) and not np.array_equal(va[1], vb[1])
    short = b"abc,def-1"
    assert len(Pieces().rows([short])[0]) == 6  # five words and the shape
    cut = "\u6f22\u5b57\u4eee" * 30 + "A1" * 40
    low = cut.encode().lower()
    assert b"".join(_words(low)) == low


def test_network_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (rng.random(6000) < p).astype(float)
    model = fit(x[:4000], y[:4000])
    got = probability(model, x[4000:])
    for lo in np.arange(0, 1, 0.25):
        inside = (got >= lo) & (got < lo + 0.25)
        assert abs(got[inside].mean() - y[4000:][inside].mean()) < 0.1
    assert pooled(np.zeros(0, np.int32), np.array([0, 0]), np.zeros((BUCKETS, 4), np.float32), np.zeros(BUCKETS, np.float32), np.array([0, 0])).sum() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = identify(docs).collect()
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out if r.held_out]) > 0.97
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in identify(changed).collect()} == {r.doc_id: r.lang_pred for r in out}


def plain_rank(text, longest=3):
    n = Counter()
    for piece in text.lower().split():
        for w in "".join(c if c.isalpha() else " " for c in piece).split():
            padded = f" {w} "
            n.update(w)
            for size in range(2, longest + 1):
                n.update(padded[i:i + size] for i in range(len(padded) - size + 1))
    return sorted(n, key=lambda g: (-n[g], g))


def test_distances_against_plain(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog, the end", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"),
                                                       ("and then the other one", "en"), ("und dann der andere", "de"), ("et puis l'autre", None)] * 8)]
    out = identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), profile=30).collect()
    learned = [(t, lang) for i, t, lang in rows if lang and remainder(i, 4) != 2]
    ranks = {x: plain_rank(" ".join(t for t, lang in learned if lang == x))[:30] for x in {"en", "de", "fr"} if any(lang == x for _, lang in learned)}
    for r in out:
        doc = plain_rank(rows[r.doc_id][1])[:30]
        away = {x: sum(abs(i - p.index(g)) if g in p else 30 for i, g in enumerate(doc)) for x, p in ranks.items()}
        best = min(sorted(away), key=away.get)
        near = {x: 1 - a / (30 * len(doc)) for x, a in away.items()}
        assert r.lang_pred == best and math.isclose(r.score, near[best] / sum(near.values()))


def test_rank_document_ties_by_gram():
    g = Grams()
    ids = np.frombuffer(g._of("zab"), "<i4")
    assert [g.names[i] for i in rank_document(ids, g, 400)] == plain_rank("zab")


def test_language_edges(edge_docs, no_docs):
    out = identify(edge_docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in edge_docs.collect())
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 10))
    assert by[6].lang_pred == "en"
    nothing = identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert identify(no_docs).collect() == []
    with pytest.raises(ValueError):
        identify(edge_docs, max_languages=1)
