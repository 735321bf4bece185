"""Quality classifier: random-indexing word vectors, pooled per document, and
a two-layer numpy network with temperature-calibrated probabilities.

1. Words (lower-case letters, other signs, and the shape of the piece) fall
   into ``BUCKETS`` hashed buckets.  All words of a piece count, whatever its
   length; a run of letters over ``LONG`` bytes (prose without spaces, encoded
   data) is read as short consecutive grams that cover it.  Every bucket has a fixed sparse index
   vector of a few +1 and -1; the context vector of a bucket is the sum of the
   index vectors of its neighbours over all documents.  Each task adds up one
   matrix; the matrices are summed by blocks of buckets, so the model's size
   does not depend on the input.
2. A document is pooled: mean and spread of its words' unit context vectors,
   weighted by their information (negative log of the bucket's share), and
   counts that describe its words.  Pooled rows are written once.
3. A two-layer network is fitted on at most ``max_train`` labelled rows (those
   of smallest id hash); a part of them sets the temperature that makes the
   probabilities match the labels.

Labels, language, source and id are inputs of no score.  Labels of documents
that are held out are not read; an id with conflicting labels is not learned
from.

Defined results: null and empty texts are scored as a document without words;
null ids and rows that repeat give a row each (a null id is not held out); an
empty table gives none; without labels of both kinds the score is the share of
label 1 (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import as_text, chunks, held_out, utf8, worker_cache, written

BUCKETS = 1 << 14
DIM = 48
NONZERO = 4
REACH = 2
BLOCK = 128
SEED = 5
MAX_TRAIN = 20_000
HIDDEN = 32
THRESHOLD = 0.3
#: Pieces whose buckets a Python worker keeps.
KEPT_PIECES = 400_000
#: Words whose neighbours a task adds up at once.
TASK_WORDS = 2_000_000
N_SHAPES = 8

#: Bytes of a run of letters that is one word; longer runs are cut into grams.
LONG = 64

_SPLIT = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+")
#: Grams of a long run: two characters beyond ASCII, or eight ASCII signs.
_GRAM = re.compile(rb"[a-z0-9]{1,8}|(?:[\xc0-\xff][\x80-\xbf]*|[\x80-\xbf]){1,2}")


def _words(low: bytes) -> Iterator[bytes]:
    """The words of a long piece, one at a time."""
    for m in _SPLIT.finditer(low):
        w = m.group()
        if len(w) > LONG and _GRAM.match(w):
            yield from (g.group() for g in _GRAM.finditer(w))
        else:
            yield w


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's nonzero components."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((buckets, dim)), axis=1)[:, :nonzero], rng.choice([-1, 1], (buckets, nonzero))


class Pieces:
    """Buckets of white-space-separated pieces: one or more words each, and
    the shape of the piece (letter case, signs, digits)."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.kept: dict[bytes, bytes] = {}

    def _of(self, piece: bytes) -> bytes:
        low = piece.lower()
        words = _SPLIT.findall(low) if len(low) <= LONG else _words(low)
        text = piece.decode("utf-8", "replace")
        shape = (text.isupper() and len(text) > 1) + 2 * any(c.isdigit() for c in text) + 4 * (not text[-1:].isalnum())
        n = self.buckets - N_SHAPES
        return np.fromiter(chain((N_SHAPES + zlib.crc32(w) % n for w in words), (shape,)), "<i4").tobytes()

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All buckets of the texts, one after the other, and the end of each text."""
        split = [t.split() for t in texts]
        kept = self.kept
        fresh = {p: self._of(p) for p in set().union(*split).difference(kept)} if split else {}
        if len(kept) + len(fresh) <= KEPT_PIECES:
            kept.update((k, v) for k, v in fresh.items() if len(k) <= 64)
        find = kept.get
        joined = [b"".join([find(p) or fresh[p] for p in s]) for s in split]
        return np.frombuffer(b"".join(joined), "<i4"), np.cumsum([len(j) // 4 for j in joined])


def pieces_of(buckets: int) -> Pieces:
    return worker_cache(f"pieces {buckets}", lambda: Pieces(buckets))


def context_vectors(docs: DataFrame, text_col: str, buckets: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, dim) context vectors over all documents, and the buckets' counts."""
    def run(batches):
        place, sign = index_vectors(buckets, dim, seed=seed)
        total, count = np.zeros(buckets * dim), np.zeros(buckets, np.int64)
        key = np.int32 if buckets * buckets < 1 << 31 else np.int64

        def add(held: list[np.ndarray]) -> None:
            """Texts are set apart by as many -1 as the reach, so no pair spans two."""
            nonlocal total, count
            ids = np.concatenate(held)
            count += np.bincount(ids[ids >= 0], minlength=buckets)
            pairs = []
            for away in range(1, REACH + 1):
                left, right = ids[:-away], ids[away:]
                same = (left >= 0) & (right >= 0)
                left, right = left[same].astype(key), right[same].astype(key)
                pairs.append(np.minimum(left, right) * buckets + np.maximum(left, right))
            # every pair of neighbours once, with its count
            pairs = np.sort(np.concatenate(pairs))
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            times = np.diff(first, append=len(pairs))
            left, right = np.divmod(pairs[first].astype(np.int64), buckets)
            for a, b in ((left, right), (right, left)):
                for j in range(NONZERO):
                    total += np.bincount(a * dim + place[b, j], weights=sign[b, j] * times, minlength=buckets * dim)

        held, n = [], 0
        gap = np.full(REACH, -1, "<i4")
        for whole in batches:
            for batch in chunks(whole):
                ids, ends = pieces_of(buckets).rows(utf8(batch))
                for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                    held += [ids[a:b], gap]
                n += len(ids)
                if n > TASK_WORDS:
                    add(held)
                    held, n = [], 0
        if n:
            add(held)
        if count.any():
            total, blocks = total.reshape(-1, BLOCK * dim), np.arange(buckets // BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), pa.array([x.astype("<i8").astype("<f4").tobytes() for x in total], pa.binary()),
                 pa.array([x.astype("<i8").tobytes() for x in count.reshape(-1, BLOCK)], pa.binary())], ["block", "total", "count"])

    schema = "block bigint, total binary, count binary"

    def added(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, t, c in zip(*(batch.column(x).to_pylist() for x in ("block", "total", "count")), strict=True):
                t, c = np.frombuffer(t, "<f4").astype(np.float64), np.frombuffer(c, "<i8")
                if block in held:
                    held[block][0] += t
                    held[block][1] += c
                else:
                    held[block] = [t, c.copy()]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([x[0].astype("<f4").tobytes() for x in held.values()], pa.binary()),
                 pa.array([x[1].tobytes() for x in held.values()], pa.binary())], schema.replace(" bigint", "").replace(" binary", "").split(", "))

    parts = docs.select(as_text(text_col).alias("text")).mapInArrow(run, schema)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors, counts = np.zeros((buckets, dim), np.float32), np.zeros(buckets, np.int64)
    # buckets / BLOCK rows of a fixed size, whatever the input
    for r in parts.repartition(min(n, buckets // BLOCK), "block").mapInArrow(added, schema).collect():
        at = r["block"] * BLOCK
        vectors[at:at + BLOCK] = np.frombuffer(r["total"], "<f4").reshape(BLOCK, dim)
        counts[at:at + BLOCK] = np.frombuffer(r["count"], "<i8")
    return vectors, counts


def pooled(ids: np.ndarray, ends: np.ndarray, unit: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of the texts: weighted mean and spread of their words' unit
    vectors, and counts that describe them."""
    starts, n = np.r_[0, ends[:-1]].astype(np.int64), len(ends)
    dim = unit.shape[1]
    out = np.zeros((n, 2 * dim + N_SHAPES + 7), np.float32)
    for i in range(n):
        x = ids[starts[i]:ends[i]]
        if not len(x):
            continue
        b, c = np.unique(x, return_counts=True)
        shapes = b < N_SHAPES
        out[i, 2 * dim + b[shapes]] = c[shapes] / max(c[shapes].sum(), 1)
        b, c = b[~shapes], c[~shapes]
        total = c.sum()
        if not total:
            continue
        w = weight[b] * c
        p, u = w / max(w.sum(), 1e-9), unit[b]
        mean = p @ u
        out[i, :dim] = mean
        out[i, dim:2 * dim] = np.sqrt(np.maximum(p @ (u * u) - mean * mean, 0))
        share = c / total
        out[i, 2 * dim + N_SHAPES:] = (math.log1p(total), len(b) / total, -(share * np.log(share)).sum(), share.max(), weight[b] @ share,
                                       (mean * mean).sum(), math.log1p(lengths[i] / total))
    return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, seed: int = SEED, epochs: int = 60) -> dict:
    """Two layers (tanh, logistic) by Adam on four fifths of the rows; the last
    fifth stops the training and sets the temperature."""
    rng = np.random.default_rng(seed)
    mean, sd = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / sd).clip(-8, 8)
    held = np.arange(len(z)) % 5 == 4
    if len(np.unique(y[held])) < 2:
        held = np.zeros(len(z), bool)
    train = np.flatnonzero(~held)
    par = [rng.normal(0, 1 / math.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    step, best, best_par = 0, np.inf, [p.copy() for p in par]

    def logits(rows, par):
        return np.tanh(rows @ par[0] + par[1]) @ par[2] + par[3][0]

    def loss(s, t):
        return float(np.mean(np.logaddexp(0, s) - t * s))

    check = np.flatnonzero(held) if held.any() else train
    for _ in range(epochs):
        order = rng.permutation(train)
        for i in range(0, len(order), 256):
            rows = order[i:i + 256]
            a, t = z[rows], y[rows]
            h = np.tanh(a @ par[0] + par[1])
            g = (1 / (1 + np.exp(-(h @ par[2] + par[3][0]).clip(-40, 40))) - t) / len(rows)
            back = np.outer(g, par[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * par[0], back.sum(0), h.T @ g + 1e-4 * par[2], np.array([g.sum()])]
            step += 1
            for j, d in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * d
                v[j] = 0.999 * v[j] + 0.001 * d * d
                par[j] = par[j] - 3e-3 * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
        now = loss(logits(z[check], par), y[check])
        if now < best:
            best, best_par = now, [p.copy() for p in par]
    s = logits(z[check], best_par)
    temperature = min(np.geomspace(0.25, 8, 61), key=lambda c: loss(s / c, y[check]))
    return {"mean": mean, "sd": sd, "par": best_par, "temperature": float(temperature)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["par"]
    s = np.tanh(((x - model["mean"]) / model["sd"]).clip(-8, 8) @ p[0] + p[1]) @ p[2] + p[3][0]
    return 1 / (1 + np.exp(-(s / model["temperature"]).clip(-40, 40)))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  mod: int = 5, rest: int = 0, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, buckets: int = BUCKETS,
                  dim: int = DIM, seed: int = SEED, row: bool = False) -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted; with ``row`` also
    the document's columns as a struct ``row``."""
    spark = docs.sparkSession
    vectors, counts = context_vectors(docs, text_col, buckets, dim, seed)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = counts[N_SHAPES:] / max(counts[N_SHAPES:].sum(), 1)
    weight = np.concatenate([np.zeros(N_SHAPES), -np.log(np.maximum(share, 1e-7))]).astype(np.float32)
    # at most buckets * (dim + 1) * 4 bytes
    model = spark.sparkContext.broadcast((unit.astype(np.float32), weight))
    width = 2 * dim + N_SHAPES + 7

    def features(batches):
        unit, weight = model.value
        for whole in batches:
            for batch in chunks(whole):
                texts = utf8(batch)
                ids, ends = pieces_of(buckets).rows(texts)
                x = pooled(ids, ends, unit, weight, np.array([len(t) for t in texts]))
                x = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float32()))
                carried = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), x], [*carried, "x"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"), *([F.struct(*docs.columns).alias("row")] if row else []))
    carried = T.StructType([f for f in d.schema.fields if f.name != "text"])
    rows = d.mapInArrow(features, T.StructType([*carried.fields, T.StructField("x", T.ArrayType(T.FloatType()))]))
    rows = written(rows.withColumn("held_out", held_out("doc_id", mod, rest)), "quality-rows")
    known = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", mod, rest))
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top")
             .select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # a repeated id gives one row; bounded by max_train
    sample = rows.filter(~F.col("held_out")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.max("x").alias("x"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    flat = float(y.mean()) if len(y) else 0.5
    fitted = None
    if len(np.unique(y)) == 2:
        x = np.asarray(sample.column("x").combine_chunks().flatten(), np.float64).reshape(len(y), width)
        fitted = fit(x, y)

    def scores(batches):
        for batch in batches:
            n = batch.num_rows
            if fitted is None:
                s = np.full(n, flat)
            else:
                s = probability(fitted, np.asarray(batch.column("x").flatten(), np.float64).reshape(n, width))
            more = [batch.column("row")] if row else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *more],
                                             ["doc_id", "held_out", "score", "predicted", "row"][:4 + row])

    out = T.StructType.fromDDL("doc_id bigint, held_out boolean, score double, predicted int")
    return rows.mapInArrow(scores, T.StructType([*out.fields, *([d.schema["row"]] if row else [])]))
