"""Embedding calls with a ledger: finished chunks are never called for again."""

import os

import numpy as np
import pytest

from tenderlake.operators.ledger import embed_with_ledger, finish_chunk, read_ledger
from tenderlake.operators.providers import HashedTF


def model(folder, fail_after=None):
    """Counts its calls as files; fails once ``fail_after`` calls are made."""
    def fn(texts):
        if fail_after is not None and len(os.listdir(folder)) >= fail_after:
            raise RuntimeError("model is down")
        open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}-{hash(texts[0])}", "w").write("\n".join(texts))
        return np.array([[len(t), sum(map(ord, t)) % 97] for t in texts], np.float32)
    return fn


@pytest.fixture
def texts(spark):
    rows = [(i, f"text {i % 230}", "x") for i in range(400)] + [(900, None, "y"), (901, "", "y"), (None, "text 1", "z")]
    return spark.createDataFrame(rows, "id bigint, text string, digest string")


def test_a_run_that_broke_off_goes_on(spark, texts, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    uri = f"file://{tmp_path}/ledger"
    with pytest.raises(Exception, match="model is down"):
        embed_with_ledger(texts, "text", model(str(calls), 3), 2, "m", uri, chunk_rows=10, concurrency=2)
    before = len(os.listdir(calls))
    stored = read_ledger(spark, uri, "m").count()
    assert 3 <= before <= 4 and stored > 0
    out = embed_with_ledger(texts, "text", model(str(calls)), 2, "m", uri, chunk_rows=10, concurrency=2)
    got = out.collect()
    assert len(got) == 403 and out.columns == ["id", "text", "digest", "embedding"]
    assert all(r.embedding == [len(r.text or ""), sum(map(ord, r.text or "")) % 97] for r in got)
    # no text was given to the model again once its chunk was stored
    sent = [t for f in os.listdir(calls) for t in open(f"{calls}/{f}").read().split("\n")]
    assert len(sent) == len(set(sent)) == 231
    now = len(os.listdir(calls))
    assert embed_with_ledger(texts, "text", model(str(calls)), 2, "m", uri).count() == 403 and len(os.listdir(calls)) == now


def test_a_task_that_runs_again_skips_its_chunks(tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    for want in (True, False, False):
        assert finish_chunk(f"{tmp_path}/ledger", ["a", "b"], ["x", "yy"], model(str(calls)), "m", 2) is want
    assert len(os.listdir(calls)) == 1 and finish_chunk(f"{tmp_path}/ledger", ["a", "b"], ["x", "yy"], model(str(calls)), "other", 2)


def test_provider_interface(spark, texts):
    p = HashedTF()
    assert p.info() == {"provider": "hashed_tf", "model": "hashed-tf-64", "dimension": 64, "max_tokens": None, "price_per_1k": p.price_per_1k}
    r = p.estimate(texts, "text").first()
    words = sum(len((t.text or "").split()) for t in texts.collect())
    assert (r.texts, r.tokens, r.over_limit) == (403, int(words * 1.3), 0) and r.cost_usd == pytest.approx(int(words * 1.3) / 1000 * p.price_per_1k)
