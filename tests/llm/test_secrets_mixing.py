import hashlib
import math
import random
import re
import string
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tenderlake.llm.mixing import apportion, mix_sources, source_targets
from tenderlake.llm.secrets import WINDOW, redact, redact_documents, scan, scan_documents, window_entropies


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text)
           if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_base_spans_against_plain(spark, sf, edge_docs, no_docs):
    names = ["assign", "access", "hex"]
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), edge_docs):
        texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        got = sorted(scan_documents(docs).collect(), key=lambda r: str(r.doc_id))
        want = sorted((i, *[sum(k == n for _, k, _ in plain_base(t)) for n in range(3)],
                       hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in plain_base(t)).encode()).hexdigest()) for i, t in texts)
        assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert scan_documents(no_docs).collect() == []


def test_window_entropy_by_counts():
    s = "aB3+xK9/qq7Zm1Lp0oU=abcabcabcabcabcabcabc0123456789abcdef"
    for i, (bits, _) in enumerate(window_entropies(s)):
        w = s[i:i + WINDOW]
        want = -sum(w.count(c) / WINDOW * math.log2(w.count(c) / WINDOW) for c in set(w))
        assert math.isclose(bits, want, abs_tol=1e-9)


def test_entropy_spans_and_allow_list():
    key = "q7Zm1Lp0oUx9Kt4vB2nR8sWc"
    base, more = scan(f"here is {key} in a text")
    assert base == [] and [(a, b) for a, _, b in more] == [(8, 8 + len(key))]
    for fine in ("internationalization_of-everything/else", "123e4567-e89b-12d3-a456-426614174000", "2024-01-02-2024-01-03-2024-01-04", "xyz1xyz1xyz1xyz1xyz1xyz1xyz1",
                 "sha256-q7Zm1Lp0oUx9Kt4vB2nR8sWcq7Zm1Lp0oUx9Kt4vB2nR="):
        assert scan(f"a {fine} b") == ([], [])
    assert redact(f"x password=abcdef1 y {key} z") == "x [SECRET] y [SECRET] z"
    assert redact("nothing here") == "nothing here" and redact("") == ""


def test_letters_only_keys():
    rng = random.Random(8)
    for n in (24, 32, 64):
        found = 0
        for _ in range(400):
            key = "".join(rng.choice(string.ascii_letters) for _ in range(n))
            base, more = scan(f"the key {key}, it is")
            assert base == [] and all(k == "entropy_letters" for _, k, _ in more)
            found += sum(b - a for a, _, b in more) >= 20
        assert found >= 380  # few random keys repeat letters much
    for fine in ("internationalizationOfEverythingElse", "TheQuickBrownFoxJumpsOverTheLazyDog", "src/main/java/org/example/AbstractSingletonFactory", "INTERNATIONALIZATION_SETTINGS",
                 "donaudampfschifffahrtsgesellschaft", "Donaudampfschifffahrtsgesellschaft", "thehestanedonthatationererhe_onthinges"):
        assert scan(f"a {fine} b") == ([], [])


def test_many_spans_of_both_kinds():
    """A text full of secrets: spans inside base spans go, as by comparing all."""
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    text = " ".join(f"token={key(30)}" if i % 3 else key(40) for i in range(3000))
    base, more = scan(text)
    assert len(base) == 2000 and len(more) >= 1000
    inside = {x for x in more for b in base if b[0] <= x[0] and x[2] <= b[2]} if len(base) < 100 else set()
    assert not inside and all(text[a - 1:a] == " " or "=" not in text[a - 8:a] for a, _, _ in more[:50])


def test_redact_documents(edge_docs, no_docs):
    out = redact_documents(edge_docs)
    assert out.schema == edge_docs.schema and out.count() == edge_docs.count()
    r = out.filter("doc_id = 9").first()
    assert r.text == "[SECRET] [SECRET]" and r.n_chars == len(r.text)
    assert out.filter("text is null").count() == edge_docs.filter("text is null").count()
    assert redact_documents(no_docs).collect() == []


def shared_targets(caps, weights):
    """Share, cap, and share the excess again until none is above."""
    total, out, free = sum(caps.values()) / 3, {}, list(caps)
    while True:
        rest = total - sum(out.values())
        w = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / w > caps[s] + 1e-9]
        if not over:
            return out | {s: rest * weights[s] / w for s in free}
        for s in over:
            out[s] = caps[s]
            free.remove(s)


def test_targets_by_water_filling(spark):
    for sizes in ([100, 5, 900, 40, 0], [10], [1, 1000], [7, 7, 7, 7, 7, 7, 7000], [0, 0]):
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        df = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, source_size bigint, n_docs bigint")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = shared_targets({n: 3 * s for n, s in zip(names, sizes, strict=True)}, {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)})
        assert got == pytest.approx(want)


def test_apportion_takes_the_highest_quotients(spark):
    for votes, seats in (([53, 24, 23], 7), ([1000, 1, 1, 1], 50), ([5, 5, 5], 4), ([0, 3], 5), ([9, 1], 0), ([100_000, 99, 98, 1, 1], 5000), ([1], 3)):
        df = spark.createDataFrame([(1, i, v, seats) for i, v in enumerate(votes)], "g int, k int, v bigint, s bigint")
        got = {r.k: r.q for r in apportion(df, ["g"], ["k"], "v", "s", "q").collect()}
        want = dict.fromkeys(range(len(votes)), 0)
        for _ in range(seats):
            best = max((k for k in want if votes[k]), key=lambda k: (Fraction(votes[k], 2 * want[k] + 1), -k))
            want[best] += 1
        assert got == want, (votes, seats)


def test_many_sources(spark):
    """A source of its own for nearly every document, one with a third of all."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), "big" if i % 3 == 0 else None if i % 101 == 1 else f"s{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix_sources(df, shard_docs=50)
    assert "SinglePartition" not in got._jdf.queryExecution().toString() or got.count() == 1200
    by = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + len(t.split())
    names = sorted(by, key=lambda x: (x is None, x or ""))
    want = shared_targets({s: 3 * n for s, n in by.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    source = {i: s for i, _, s in rows}
    assert {source[r.doc_id]: round(r.target, 6) for r in got.collect()} == {s: pytest.approx(t, abs=1e-5) for s, t in want.items()}


def test_mix(spark, sf, edge_docs, no_docs):
    for docs, shard in ((spark.read.parquet(f"{sf}/documents.parquet"), 7), (edge_docs, 1000)):
        rows = mix_sources(docs, shard_docs=shard).collect()
        again = mix_sources(docs.repartition(5), shard_docs=shard).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        texts = docs.select("doc_id", "text").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), size(r.text)) for r in texts)
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        by = {}
        for r in rows:
            by.setdefault((r.source_size, r.target), []).append(r.taken)
        for (source_size, target), taken in by.items():
            assert abs(sum(taken) - target) <= 32 + 32 * len(taken) / shard, (source_size, target)
    assert mix_sources(no_docs).collect() == []
    assert mix_sources(edge_docs, keep=["lang", "row"]).columns[-2:] == ["lang", "row"]
    assert mix_sources(edge_docs.withColumn("text", F.lit(None).cast("string"))).agg({"taken": "sum"}).first()[0] == 0
