import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderlake.llm.collocations import collocations, counted, decode_filter, encode_filter, half_bits, merged, permuted, restored


def plain(docs, min_count=10, top=2000, drop=50):
    """All phrases in dictionaries of Python numbers."""
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *words), a in f.items():
        if a < min_count or len(words) < 2:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang, *words] = (a, f[lang, *words[:k]], f[lang, *words[k:]], score)
    longer = [(key, v[0]) for key, v in out.items() if len(key) == 4]
    gone = {(lang, *p) for (lang, x, y, z), m in longer for p in ((x, y), (y, z)) if (lang, *p) in out and 100 * m >= drop * out[lang, *p][0]}
    by = {}
    for (lang, *words), (a, l, r, score) in out.items():  # noqa: E741
        if (lang, *words) not in gone:
            by.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), a, l, r, score))
    return sorted((lang, i + 1, p.decode(), a, l, r, n[lang], score) for lang, rows in by.items() for i, (_, _, p, a, l, r, score) in enumerate(sorted(rows)[:top]))


numbers = st.lists(st.tuples(*[st.integers(0, (1 << 42) - 1)] * 3), min_size=1, max_size=50)


@settings(max_examples=60, deadline=None)
@given(numbers, st.integers(1, 42))
def test_permutation_can_be_inverted(rows, bits):
    a, b, c = (np.array(x, np.int64) & ((1 << bits) - 1) for x in zip(*rows, strict=True))
    left, right = permuted(a, b, c, bits)
    assert int(left.max()) < 1 << half_bits(bits) and int(right.max()) < 1 << half_bits(bits)
    assert [x.tolist() for x in restored(left, right, bits)] == [x.tolist() for x in (a, b, c)]


@settings(max_examples=60, deadline=None)
@given(numbers, st.integers(1, 42), st.integers(0, 8), st.integers(0, 400))
def test_filters_are_lossless(rows, bits, prefix, more):
    a, b, c = (np.array(x * (1 + more % 7), np.int64) & ((1 << bits) - 1) for x in zip(*rows, strict=True))
    h = half_bits(bits)
    prefix = min(prefix, h)
    e = counted(*permuted(a, b, c, bits))
    e = (e[0], e[1], e[2] + more * 1000 * (e[2] > 1))
    which = (e[0] >> np.uint64(h - prefix)).astype(np.int64)
    back = []
    for v in np.unique(which):
        part = tuple(x[which == v] for x in e)
        back.append(decode_filter(encode_filter(part, h, prefix), h, prefix, int(v)))
        assert [x.tolist() for x in back[-1]] == [x.tolist() for x in part]
    assert [x.tolist() for x in merged(back + back)] == [e[0].tolist(), e[1].tolist(), (2 * e[2]).tolist()]


def test_even_ranges():
    """The permutation spreads phrases of neighbouring ids evenly."""
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, 300), np.arange(1, 300)))
    left, _ = permuted(a, b, np.zeros_like(a), 17)
    n = np.bincount((left >> np.uint64(half_bits(17) - 5)).astype(int), minlength=32)
    assert n.max() < 1.1 * n.min()


EDGE = "text string, lang string, word string, f int, id string, chunk int, w1 string, rank string, n int"


@pytest.fixture(scope="module")
def edge(spark):
    hot = "Same line, AGAIN and again and again; the end\n"
    texts = [(hot, "en")] * 40 + [(hot, None)] * 6 + [(hot, "und")] * 5 + [(None, "en"), ("", "en"), (" \t\n.,;", None), ("é Éa É日本 x\x00y zw x\x00y zw\x0bx\x00y zw" * 6, "fr"),
             ("tick tock " * 60_000, "de"), ("a.b c,d e\tf  g" * 30, "es"), ("x y z. " * 10 + "x y. " * 9, "p"), ("x y z. " * 10 + "x y. " * 11, "q")]
    return texts, spark.createDataFrame([(*t, "w", 1, "i", 2, "v", "r", 3) for t in texts], EDGE)


@pytest.mark.parametrize("kw", [{}, {"min_count": 2, "top": 7, "range_entries": 64}, {"min_count": 1, "drop_percent": 100, "range_entries": 1000}])
def test_edges_against_plain(edge, kw):
    texts, df = edge
    got = collocations(df.repartition(5), **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(texts, kw.get("min_count", 10), kw.get("top", 2000), kw.get("drop_percent", 50))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_whole_table_against_plain(spark, sf):
    from tenderlake.llm.queries import op12_collocations

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    assert sorted(tuple(r) for r in op12_collocations(spark, sf).collect()) == plain(docs)


def test_empty(edge):
    _, df = edge
    assert collocations(df.filter(F.lit(False))).collect() == []
    assert collocations(df.filter("text is null")).collect() == []
