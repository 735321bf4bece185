import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tenderlake.llm.components import components
from tenderlake.llm.embedding_dedup import near_duplicates
from tenderlake.llm.simhash import allocate, fingerprint, near_links, partition_bits, simhash_classes
from tenderlake.llm.topk import exact_topk


def least_of(nodes, links):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(1000, 1040)]
    loose = [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    links = [*chain, *hub, *loose, (7, 7), (100, 101), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [x for x in links if x[0] != x[1]]
    nodes = {n for x in real for n in x}
    assert got == least_of(nodes, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(edge_docs):
    texts = [r.text or "" for r in edge_docs.collect()] + ["A b", "a B c", "É é\x0bX  \x1c y", "a\x00b c d"]
    for t in texts:
        assert fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize(("max_bits", "limit"), [(2, 200), (2, 1), (3, 200), (3, 1), (1, 2), (0, 5)])
def test_links_against_all_pairs(spark, max_bits, limit):
    rng = random.Random(max_bits)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = {0, (1 << 64) - 1, *base}
    for x in base[:12]:  # chains and balls around some
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), max_bits, bucket_limit=limit).collect()
    close = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= max_bits
    assert all(close(a, b) for a, b in links)
    real = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if close(a, b)]
    assert least_of(signed, links) == least_of(signed, real)


def test_allocation_is_complete():
    for max_bits in range(5):
        _, t = allocate([5.0, 0.1, 30.0, 2.0], [0.5, 0.9, 0.6, 0.7], [16] * 4, max_bits)
        assert sum(x + 1 for x in t) == max_bits + 1 and min(t) >= -1
    together = np.full((64, 64), 25.0)
    np.fill_diagonal(together, 50)
    together[:8, :8] = 50  # eight bits that go together
    parts = partition_bits(100, together, 4)
    assert sorted(sum(parts, [])) == list(range(64))
    assert any(set(range(8)) <= set(g) for g in parts)


def test_classes(edge_docs, no_docs, spark):
    out = simhash_classes(edge_docs).collect()
    want = sorted((str(r.doc_id), f"{plain_fingerprint(r.text):016x}") for r in edge_docs.collect())
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values())
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {3}  # null, empty and blank texts, a null id among them
    assert {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    assert simhash_classes(no_docs).collect() == []


SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, code string, dim double"
BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] + [1.0] * 15, 1),
       (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0] * 16, None), (None, [1.0] * 16, 1), (906, [], 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(240):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 30 % 3)))
    rows += [(240, rows[0][1], 0), (241, [2 * x for x in rows[0][1]], 0), (0, rows[0][1], 0), (950, [1.0, 2.0], 1), (951, [1.0, 2.0], 1)]
    return spark.createDataFrame([(*r, 1, "c", 0.5) for r in [*rows, *BAD]], SCHEMA)


@pytest.mark.parametrize("chunk", [512, 4])
def test_embedding_links_against_all_pairs(vectors, chunk):
    rows = vectors.collect()
    bad = {str(x[0]) for x in BAD}
    good = [r for r in rows if str(r.vec_id) not in bad]
    unit = [np.array(r.embedding, np.float64) / np.linalg.norm(np.array(r.embedding, np.float64)) for r in good]
    linked = lambda i, j: good[i].label == good[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    pairs = [(i, j) for i in range(len(good)) for j in range(i + 1, len(good)) if linked(i, j)]
    low = least_of(range(len(good)), pairs)
    n = np.zeros(len(good), int)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    least = {}
    for i, r in enumerate(good):
        least[low[i]] = min(least.get(low[i], r.vec_id), r.vec_id)
    want = [(r.vec_id, n[i], least[low[i]], r.vec_id == least[low[i]]) for i, r in enumerate(good)]
    want += [(r.vec_id, 0, r.vec_id, True) for r in rows if str(r.vec_id) in bad]
    got = [tuple(r) for r in near_duplicates(vectors, chunk=chunk).collect()]
    assert sorted(map(str, got)) == sorted(str((a, int(b), c, bool(d))) for a, b, c, d in want)
    assert len(pairs) > 200


def test_embedding_empty(vectors):
    assert near_duplicates(vectors.filter(F.lit(False))).collect() == []


@pytest.mark.parametrize(("cb", "qb"), [(1024, 512), (16, 3)])
def test_topk_against_brute_force(vectors, cb, qb):
    v = vectors.unionByName(vectors.filter("vec_id in (3, 50)"))  # rows that repeat
    seen = {}
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding):
            seen[(r.vec_id, tuple(int(np.floor(256 * np.float64(x))) for x in r.embedding))] = 1
    want = []
    for i in sorted({k[0] for k in seen if k[0] % 50 == 0}):
        q = next(k[1] for k in seen if k[0] == i)
        s = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in seen if j != i and len(x) == len(q))
        want += [(i, n + 1, j, -d) for n, (d, j) in enumerate(s[:5])]
    got = exact_topk(v, F.col("vec_id") % 50 == 0, candidate_block=cb, query_block=qb).collect()
    assert sorted(map(tuple, got)) == want
    assert exact_topk(vectors.filter(F.lit(False)), F.col("vec_id") % 50 == 0).collect() == []


def test_topk_prunes_and_keeps_large_values_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 32)) * np.geomspace(1, 0.01, 32) * 1e4
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64)
    got = exact_topk(df, F.col("vec_id") % 50 == 0).collect()
    for r in got:
        s = q @ q[r.query_id]
        s[r.query_id] = -(1 << 62)
        assert s[r.vec_id] == r.score and (s > r.score).sum() < 5
    assert len(got) == 40
