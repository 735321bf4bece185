"""Language identification by rank-order profiles.

A profile is the ``PROFILE`` most frequent n-grams (1 to 3 signs) of a
language's words, each word padded by a space on both sides, ranked by count
and then by the n-gram.  A document is ranked in the same way; its distance to
a language is the sum over its most frequent n-grams of how far out of place
they are in the language's profile (``PROFILE`` if they are missing).  The
least distance wins, ties go to the smaller name.

Counts are taken over all documents that are not held out: each task counts
pieces, turns the distinct ones into n-grams and sends one row an n-gram.
Profiles are languages x ``PROFILE`` rows; ``MAX_LANGUAGES`` is checked before
they are sent to the tasks.

Defined results: a null text, a text without letters, and any text when
nothing was learned are ``und`` with score 0; null ids (never held out) and
rows that repeat give a row each; a null language is not learned from; an
empty table gives none; other columns are ignored.  The score is the winner's
share of all languages' nearness (1 - distance / largest distance).
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import as_text, chunks, held_out, utf8, worker_cache, written

PROFILE = 400
LONGEST = 3
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: Pieces whose n-grams a Python worker keeps, and n-grams it numbers.
KEPT_PIECES = 500_000
MAX_GRAMS = 1_000_000
SALTS = 8


class Grams:
    """Numbers of n-grams, and the n-grams of white-space-separated pieces."""

    def __init__(self, longest: int = LONGEST):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.kept: dict[str, bytes] = {}
        self._order = np.zeros(0, np.int64)
        self.ranks: dict[int, np.ndarray] = {}

    def _of(self, piece: str) -> bytes:
        words = [piece] if piece.isalpha() else "".join([c if c.isalpha() else " " for c in piece]).split()
        number, out = self.number, []
        for w in words:
            padded = f" {w} "
            for n in range(1, self.longest + 1):
                for g in w if n == 1 else [padded[i:i + n] for i in range(len(padded) - n + 1)]:
                    i = number.get(g)
                    if i is None:
                        i = number[g] = len(self.names)
                        self.names.append(g)
                    out.append(i)
        return np.array(out, "<i4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The n-grams of pieces that are not kept; keeps them while there is room."""
        fresh = {p: self._of(p) for p in pieces.difference(self.kept)}
        if len(self.kept) + len(fresh) <= KEPT_PIECES:
            self.kept.update((k, v) for k, v in fresh.items() if len(k) <= 64)
        return fresh

    def order(self) -> np.ndarray:
        """Place of every n-gram in code point order."""
        if len(self._order) != len(self.names):
            by = sorted(range(len(self.names)), key=self.names.__getitem__)
            self._order = np.empty(len(by), np.int64)
            self._order[by] = np.arange(len(by))
        return self._order

    def trim(self) -> None:
        if len(self.names) > MAX_GRAMS:
            self.clear()


def grams_of(longest: int) -> Grams:
    return worker_cache(f"grams {longest}", lambda: Grams(longest))


def profiles(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", profile: int = PROFILE,
             longest: int = LONGEST) -> DataFrame:
    """(lang, rank from 0, gram) over all rows of ``docs`` with a language."""
    def count(batches):
        for whole in batches:
            for batch in chunks(whole):
                g = grams_of(longest)
                g.trim()
                langs, by_lang = batch.column("lang").to_pylist(), {}
                for lang, text in zip(langs, utf8(batch), strict=True):
                    by_lang.setdefault(lang, []).append(text.decode("utf-8", "replace").lower().split())
                rows = ([], [], [])
                for lang, pieces in by_lang.items():
                    n = Counter(chain.from_iterable(pieces))
                    fresh = g.learn(set(n))
                    grams = [g.kept.get(p) or fresh.get(p, b"") for p in n]
                    ids = np.frombuffer(b"".join(grams), "<i4")
                    weight = np.repeat(np.fromiter(n.values(), np.int64, len(n)), [len(x) // 4 for x in grams])
                    total = np.bincount(ids, weights=weight, minlength=len(g.names)).astype(np.int64)
                    seen = np.flatnonzero(total)
                    rows[0].extend([lang] * len(seen))
                    rows[1].extend([g.names[i] for i in seen])
                    rows[2].extend(total[seen].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())],
                                                 ["lang", "gram", "n"])

    counted = (docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), as_text(text_col).alias("text"))
               .mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
               .withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))))
    rank = [F.col("n").desc(), F.col("gram").cast("binary")]
    # the best of each part of a language first, then the best of those
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*rank))).filter(F.col("r") <= profile).drop("r")
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*rank)) - 1)
            .filter(F.col("rank") < profile).select("lang", "rank", "gram"))


def rank_document(ids: np.ndarray, g: Grams, profile: int) -> np.ndarray:
    """The document's most frequent n-grams, ties in code point order."""
    if len(g.names) <= 8 * len(ids):
        n = np.bincount(ids, minlength=len(g.names))
        seen = np.flatnonzero(n)
        n = n[seen]
    else:
        seen, n = np.unique(ids, return_counts=True)
    key = (n.astype(np.int64) << 32) - g.order()[seen]  # by count, then by place
    if len(key) > profile:
        best = np.argpartition(key, len(key) - profile)[len(key) - profile:]
        seen, key = seen[best], key[best]
    return seen[np.argsort(-key)]


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2,
             profile: int = PROFILE, longest: int = LONGEST, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """A row a document: doc_id, held_out, lang_pred, score."""
    learned = written(profiles(docs.filter(~held_out(id_col, mod, rest)), lang_col=lang_col, text_col=text_col, profile=profile, longest=longest), "lang-profiles")
    if learned.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages: pass a larger max_languages if their profiles fit the tasks")
    rows = learned.toArrow().to_pydict()  # at most max_languages * profile rows
    langs = sorted(set(rows["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    where: dict[str, list[tuple[int, int]]] = {}
    for lang, rank, gram in zip(rows["lang"], rows["rank"], rows["gram"], strict=True):
        where.setdefault(gram, []).append((at[lang], rank))
    shared = docs.sparkSession.sparkContext.broadcast((langs, where))

    def run(batches):
        langs, where = shared.value
        ranks, n_known = np.full((len(langs), 1024), -1, np.int32), 0
        for whole in batches:
            for batch in chunks(whole):
                g = grams_of(longest)
                if len(g.names) > MAX_GRAMS:
                    g.trim()
                    ranks[:], n_known = -1, 0
                texts = [t.decode("utf-8", "replace").lower().split() for t in utf8(batch)]
                fresh = g.learn(set().union(*texts)) if texts else {}
                if len(g.names) > ranks.shape[1]:
                    ranks = np.concatenate([ranks, np.full((len(langs), 2 * len(g.names) - ranks.shape[1]), -1, np.int32)], axis=1)
                for i in range(n_known, len(g.names)):
                    for lang, rank in where.get(g.names[i], ()):
                        ranks[lang, i] = rank
                n_known = len(g.names)
                preds, scores = [], []
                find = g.kept.get
                for pieces in texts:
                    ids = np.frombuffer(b"".join([find(p) or fresh.get(p, b"") for p in pieces]), "<i4")
                    if not len(ids) or not langs:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    top = rank_document(ids, g, profile)
                    r = ranks[:, top]
                    away = np.where(r >= 0, np.abs(r - np.arange(len(top))), profile).sum(axis=1)
                    near = 1 - away / (profile * len(top))
                    best = int(np.argmin(away))
                    preds.append(langs[best])
                    scores.append(float(near[best] / near.sum()) if near.sum() > 0 else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col, mod, rest).alias("held_out"), as_text(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
