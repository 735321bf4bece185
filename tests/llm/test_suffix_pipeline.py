import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlake.llm.suffix_dedup import anchors, remove_repeats, text_anchors


def plain_removal(texts, length):
    starts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def made_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(30), text(9)
    out = [text(rng.randint(0, 60)) for _ in range(25)]
    out += [f"{text(5)} {passage} {text(6)}" for _ in range(12)] + [f"{line} {text(8)} {line}" for _ in range(6)]
    near = text(50).split()
    for _ in range(10):
        copy = list(near)
        copy[rng.randrange(50)] = word()
        out.append(" ".join(copy))
    out += [out[0], out[0], out[30], "na " * 200, "x" * 90, "", None, "ab", passage * 3]
    return out


def check_removal(spark, texts, length, head, batches):
    rows = [(i if i % 9 else None, t, 1, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int, digest string").repartition(5)
    got = remove_repeats(docs, length=length, head=head, batches=batches).collect()
    want = [(r[0], *x, x[0] - x[1]) for r, x in zip(rows, plain_removal([(t or "").encode() for t in texts], length), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(("length", "head", "batches"), [(40, 8, 4), (40, 8, 1), (41, 39, 3), (30, 30, 2), (64, 5, 2)])
def test_removal_against_brute_force(spark, length, head, batches):
    check_removal(spark, made_texts(), length, head, batches)


def test_every_context_under_one_head(spark):
    """One head in every document, with left and right sides that agree for
    different lengths: all contexts meet in one group."""
    rng = random.Random(2)
    sides = ["".join(rng.choice("xyz") for _ in range(60)) for _ in range(3)]
    texts = []
    for i in range(400):
        a, b, n, m = rng.choice(sides), rng.choice(sides), rng.randrange(45), rng.randrange(45)
        texts.append("".join(rng.choice("pqrs") for _ in range(50)) + a[60 - n:] + "\x00" * 8 + b[:m] + "".join(rng.choice("tuvw") for _ in range(50)))
    check_removal(spark, texts, 40, 8, 2)


def test_removal_edges(edge_docs, no_docs):
    got = remove_repeats(edge_docs).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in edge_docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *x, x[0] - x[1])) for (i, _), x in zip(texts, plain_removal([t for _, t in texts], 400), strict=True))
    assert remove_repeats(no_docs).collect() == []


def test_segments_of_a_long_text():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    _, a, lo, hi, key, ctx = anchors([text], 50, 8)
    windows = {s: (x, int(k)) for x, f, t, k in zip(a, lo, hi, key, strict=True) for s in range(f, t + 1)}
    assert sorted(windows) == list(range(len(text) - 49))
    a, lo, hi, key, _ = text_anchors(text, 50, 8, 7, segment=700)
    assert {s: (x, int(k)) for x, f, t, k in zip(a, lo, hi, key, strict=True) for s in range(f, t + 1)} == windows


def test_pipeline_stages_on_edges(spark, sf, edge_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge_docs, sf)
        assert out.columns == edge_docs.columns
        out.collect()
        assert stage(spark, no_docs, sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf).collect() == []


def test_pipeline_decisions(spark, sf):
    from tenderlake.llm.mixing import mix_sources
    from tenderlake.llm.packing import pack_documents
    from tenderlake.llm.quality import score_quality
    from tenderlake.llm.secrets import redact
    from tenderlake.llm.simhash import simhash_classes

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]
    one = stages["quality_classifier"](spark, docs, sf)
    scores = {r.doc_id: r.score for r in score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert rows(one) == [r for r in rows(docs) if scores[r[0]] >= 0.3]
    two = stages["simhash_near_dedup"](spark, one, sf)
    assert rows(two) == rows(one.join(simhash_classes(one).filter("doc_id = component_id").select("doc_id"), "doc_id").select(*columns))
    three = stages["secret_scans"](spark, two, sf)
    at = columns.index("text")
    want = [(*r[:at], redact(r[at]), *r[at + 1:]) for r in rows(two)]
    assert [r[:-1] for r in rows(three)] == [r[:-1] for r in want] and all(r[-1] == len(r[at]) for r in rows(three))
    four = rows(stages["source_mixing"](spark, three, sf))
    taken, size = {}, lambda t: len(t.encode().split())
    for r in four:
        taken[r[0]] = taken.get(r[0], 0) + size(r[at])
    assert taken == {r.doc_id: r.taken for r in mix_sources(three).collect() if r.taken}
    whole = {r[0]: r[at] for r in rows(three)}
    for r in four:
        twice = whole[r[0]].encode().split() * 2
        words = r[at].encode().split()
        assert any(twice[i:i + len(words)] == words for i in range(len(twice) // 2 + 1))
    kept = spark.createDataFrame(four, docs.schema)
    five = stages["best_fit_packing"](spark, kept, sf)
    assert sum(r.length for r in five.collect()) == sum(r.length for r in pack_documents(kept).collect())
    assert five.filter(F.col("length") > 2048).count() == 0
