"""Vector expressions.

Distances are written as unrolled sums over a fixed dimension so that they
stay inside whole-stage codegen (higher-order functions are interpreted
per element).  Sums run left to right in double precision.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2sq", "l2", "cosine", "ip")


def _d(v: Column, i: int) -> Column:
    return v.getItem(i).cast("double")


def _left_sum(terms: list[Column]) -> Column:
    acc = terms[0]
    for t in terms[1:]:
        acc = acc + t
    return acc


# Above this dimension the unrolled sum no longer fits one generated
# method (64 KB); the sum then runs as a higher-order function instead.
UNROLL_MAX_DIM = 64


def _hof_sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))),
                       F.lit(0.0), lambda acc, t: acc + t)


def dot(a: Column, b: Column, dim: int) -> Column:
    if dim > UNROLL_MAX_DIM:
        return _hof_sum(a, b, lambda x, y: x * y)
    return _left_sum([_d(a, i) * _d(b, i) for i in range(dim)])


def sq_norm(a: Column, dim: int) -> Column:
    if dim > UNROLL_MAX_DIM:
        return _hof_sum(a, a, lambda x, y: x * y)
    return _left_sum([_d(a, i) * _d(a, i) for i in range(dim)])


def l2sq(a: Column, b: Column, dim: int) -> Column:
    if dim > UNROLL_MAX_DIM:
        return _hof_sum(a, b, lambda x, y: (x - y) * (x - y))
    terms = []
    for i in range(dim):
        diff = _d(a, i) - _d(b, i)
        terms.append(diff * diff)
    return _left_sum(terms)


def distance(metric: str, q: Column, v: Column, dim: int,
             q_norm: Column | None = None, v_norm: Column | None = None) -> Column:
    """Distance between two ARRAY<FLOAT> columns of length ``dim``.

    l2sq: squared Euclidean; l2: Euclidean; cosine: 1 - cos; ip: 1 - dot.
    Norms may be given pre-computed (ingestion stores them).  Up to
    ``UNROLL_MAX_DIM`` the sum is unrolled (whole-stage codegen).
    """
    if metric == "l2sq":
        return l2sq(q, v, dim)
    if metric == "l2":
        return F.sqrt(l2sq(q, v, dim))
    if metric == "cosine":
        qn = q_norm if q_norm is not None else F.sqrt(sq_norm(q, dim))
        vn = v_norm if v_norm is not None else F.sqrt(sq_norm(v, dim))
        den = qn * vn
        return F.when(den == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(q, v, dim) / den)
    if metric == "ip":
        return F.lit(1.0) - dot(q, v, dim)
    raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


#: White space of Python's ``str.split`` that Java's ``(?U)\\s`` leaves in words.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White space of ``_words`` beyond ASCII's, and what Python but not Spark splits at.
_ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Bytes of texts whose words are looked up together, about.
PART_BYTES = 1 << 24
#: Words whose buckets a worker remembers.
BUCKET_WORDS = 1 << 17
_BUCKETS: dict[str, int] = {}


def _word_bucket(word: str) -> int:
    """First 32 bits of the word's md5."""
    if len(_BUCKETS) >= BUCKET_WORDS:
        _BUCKETS.clear()
    b = _BUCKETS[word] = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)
    return b


def _words(text: str) -> list[str]:
    """The words of ``functions.text.words``."""
    if _NO_SPACE.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def tf_vectors(texts, dim: int) -> np.ndarray:
    """Hashed term frequencies of each text (a list of words), of length 1."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    known = _BUCKETS.get
    for i, words in enumerate(texts):
        found = [*map(known, words)]
        if None in found:
            found = [_word_bucket(w) if b is None else b for w, b in zip(words, found, strict=True)]
        if found:
            counts = np.bincount(np.array(found, dtype=np.int64) % dim, minlength=dim)
            out[i] = (counts / np.sqrt(float((counts * counts).sum()))).astype(np.float32)
    return out


def text_vectors(texts: pa.Array, dim: int) -> np.ndarray:
    """``tf_vectors`` of the words of texts without nulls; a word is looked up
    once, however often the texts hold it."""
    odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
    if odd.any():  # white space that Arrow does not split at
        out = np.zeros((len(texts), dim), dtype=np.float32)
        out[odd] = tf_vectors([_words(t) for t in texts.filter(pa.array(odd)).to_pylist()], dim)
        if not odd.all():
            out[~odd] = text_vectors(texts.filter(pa.array(~odd)), dim)
        return out
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    code, names = words.indices.to_numpy(), words.dictionary.to_pylist()
    bucket = np.array([_word_bucket(w) if (b := _BUCKETS.get(w)) is None else b for w in names], dtype=np.int64) % dim
    cell = np.repeat(np.arange(len(texts)) * dim, lists.value_lengths().to_numpy()) + bucket[code]
    if "" in names:  # at the ends of a text
        cell = cell[code != names.index("")]
    counts = np.bincount(cell, minlength=len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
    return (counts / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32)


def hashed_tf(text: Column, n_buckets: int = 64) -> Column:
    """Dense L2-normalised term-frequency vector of hashed lower-case words.

    Per row and shuffle-free, over Arrow batches: a word is looked up once a part
    of a batch, and its md5 is computed once a worker and then remembered.
    """
    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        step = min(4096, 1 + PART_BYTES * len(texts) // max(1, texts.nbytes))
        parts = [text_vectors(texts.slice(at, step), n_buckets) for at in range(0, len(texts), step)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n_buckets), pa.array(flat))

    return vectors(F.lower(F.coalesce(text, F.lit(""))))
