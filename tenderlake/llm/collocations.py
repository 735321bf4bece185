"""Phrase collocation mining with counting quotient filters.

Words and pieces.  Texts (A-Z lower-cased) are split at ``. , ; : ! ?`` and
line breaks into pieces, pieces at spaces and tabs into words.  Documents are
taken in chunks of one language and a bounded number of bytes: a chunk keeps
its distinct words with their counts, and its text as local word numbers.

Word ids.  The words that occur ``min_count`` times in their language, and no
others can be part of a candidate, are numbered densely by a distributed sort;
a chunk gets the ids of its own words by a join.

Filters.  An n-gram of ids is packed into one number of ``3 * bits`` bits (a
two-word phrase has a zero third word) and permuted by a Feistel network, which
can be inverted.  The leading bits of the result, the quotient, place it in a
slot; the rest, the full remainder, is stored, so nothing is lost and equal
entries are equal n-grams.  A filter holds its slots in order: the number of
entries of each slot in unary bits, the remainders at their width in bytes, and
counters of one byte with a list of the larger ones.  Filters are cut by the
quotient's first bits into ranges, which the permutation makes even whatever
the phrases are; the filters of one range from all chunks are merged as sorted
runs.  A hot phrase is one counter of each chunk.

Scores.  Candidates join their parts' counts; products are exact decimals of
38 digits.  A two-word candidate is dropped for a three-word one that holds it
``drop_percent`` of its times, whether that one is dropped or not (nothing is
longer, so it never is).

Defined results: a null text counts as empty, a null lang as ``und`` (with
documents that say ``und``); rows that repeat count again; documents without
words give nothing; an empty table gives no rows; other columns are ignored.
A chunk is at least one whole text, so one very long text is a chunk by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import BATCH_BYTES, as_text, chunks, prepare, release_cache, utf8, written
from tenderlake.operators.running import running_totals

MIN_COUNT = 10
TOP = 2000
DROP_PERCENT = 50
#: N-gram occurrences for each range of quotients.
RANGE_ENTRIES = 1 << 18
#: Entries that a task gathers before it hands over its filters.
HELD_ENTRIES = 1 << 20
#: Parts of a language that are ranked by themselves before the whole.
RANK_PARTS = 64

# fixed values: the characters that end a piece, and that part words
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TO = bytes(10 if c in BREAKS else 32 if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEYS = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


# ------------------------------------------------------------- permutation
def half_bits(bits: int) -> int:
    """Bits of each half of a packed n-gram of words of ``bits`` bits."""
    return (3 * bits + 1) // 2


def _round(x: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & mask


def permuted(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the permuted number of n-grams (a, b, c)."""
    h = half_bits(bits)
    one, mask = np.uint64(1), np.uint64((1 << h) - 1)
    a, b, c = (x.astype(np.uint64) for x in (a, b, c))
    low_b = h - bits  # bits of the middle word in the low half
    left = (a << np.uint64(bits - low_b)) | (b >> np.uint64(low_b))
    right = ((b & ((one << np.uint64(low_b)) - one)) << np.uint64(bits)) | c
    for key in _KEYS:
        left, right = right, left ^ _round(right, key, mask)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of ``permuted``."""
    h = half_bits(bits)
    one, mask = np.uint64(1), np.uint64((1 << h) - 1)
    for key in reversed(_KEYS):
        left, right = right ^ _round(left, key, mask), left
    low_b = h - bits
    b = ((left & ((one << np.uint64(bits - low_b)) - one)) << np.uint64(low_b)) | (right >> np.uint64(bits))
    return left >> np.uint64(bits - low_b), b, right & ((one << np.uint64(bits)) - one)


# ------------------------------------------------------------------ filters
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def counted(left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> Entries:
    """Sorted distinct entries with the sums of their counts."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    sums = np.diff(np.r_[new, len(left)]) if n is None else np.add.reduceat(n[order], new)
    return left[new], right[new], sums.astype(np.int64)


def _to_bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_bytes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel()


def encode_filter(e: Entries, h: int, prefix: int) -> bytes:
    """A counting quotient filter of sorted entries whose ``left`` agree in
    their first ``prefix`` of ``h`` bits; about one slot an entry."""
    left, right, n = e
    slot_bits = min(h - prefix, max(0, int(len(left)).bit_length() - 1))
    rest = h - prefix - slot_bits
    slot = ((left & np.uint64((1 << (h - prefix)) - 1)) >> np.uint64(rest)).astype(np.int64)
    in_slot = np.bincount(slot, minlength=1 << slot_bits)
    ends = np.zeros(len(left) + len(in_slot), np.uint8)  # a 1 for each entry, a 0 after each slot
    ends[np.arange(len(left)) + slot] = 1
    big = np.flatnonzero(n > 254)
    head = np.array([len(left), slot_bits, len(big)], "<u8").tobytes()
    return b"".join((head, np.packbits(ends).tobytes(), _to_bytes(left & np.uint64((1 << rest) - 1), (rest + 7) // 8), _to_bytes(right, (h + 7) // 8),
                     np.where(n > 254, 255, n).astype(np.uint8).tobytes(), n[big].astype("<i8").tobytes()))


def decode_filter(data: bytes, h: int, prefix: int, prefix_value: int) -> Entries:
    count, slot_bits, n_big = (int(x) for x in np.frombuffer(data, "<u8", 3))
    rest, at = h - prefix - slot_bits, 24
    n_bits = count + (1 << slot_bits)
    ends = np.unpackbits(np.frombuffer(data, np.uint8, (n_bits + 7) // 8, at), count=n_bits)
    at += (n_bits + 7) // 8
    slot = np.flatnonzero(ends) - np.arange(count)
    low = _from_bytes(data, at, count, (rest + 7) // 8)
    at += count * ((rest + 7) // 8)
    right = _from_bytes(data, at, count, (h + 7) // 8)
    at += count * ((h + 7) // 8)
    n = np.frombuffer(data, np.uint8, count, at).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", n_big, at + count)
    left = (np.uint64(prefix_value) << np.uint64(h - prefix)) | (slot.astype(np.uint64) << np.uint64(rest)) | low
    return left, right, n


def merged(parts: list[Entries]) -> Entries:
    """Sorted filters as one."""
    return counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))


# ------------------------------------------------------------------- chunks
class _Numbers(dict):
    """Words to local numbers; 0 and 1 are the empty word and the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


CHUNK = "chunk bigint, lang string, n_words bigint, words array<string>, counts array<bigint>, codes binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Documents (text, lang) as chunks of one language."""
    def run(batches):
        release_cache()
        number = TaskContext.get().partitionId() << 32
        by: dict[str, list[bytes]] = {}
        size = 0
        for batch in (piece for b in batches for piece in chunks(b)):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch), strict=True):
                by.setdefault(lang, []).append(text)
                size += len(text)
            # a language that fills a chunk goes, and all go when together they fill two
            for lang in sorted(by):
                own = sum(map(len, by[lang]))
                if own >= BATCH_BYTES // 2 or size >= 2 * BATCH_BYTES:
                    yield one_chunk(number, lang, by.pop(lang))
                    number, size = number + 1, size - own
        for lang in sorted(by):
            yield one_chunk(number, lang, by[lang])
            number += 1

    return docs.mapInArrow(run, CHUNK)


def one_chunk(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    ids = _Numbers({b"": 0, b"\n": 1})
    words = b"\n".join(texts).translate(_TO).replace(b"\n", b" \n ").split(b" ")
    codes = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
    codes = codes[codes > 0]
    counts = np.bincount(codes, minlength=len(ids))[2:]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()),
         pa.array([[w.decode() for w in list(ids)[2:]]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())],
        ["chunk", "lang", "n_words", "words", "counts", "codes"])


def phrase_filters(coded: DataFrame, bits: int, prefix: int) -> DataFrame:
    """Filters of all two- and three-word phrases: rows (range, filter).
    ``coded`` has codes and the ids of the chunk's words (position, id)."""
    h = half_bits(bits)

    def handed(e: Entries) -> pa.RecordBatch:
        which = (e[0] >> np.uint64(h - prefix)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(which[1:] != which[:-1]) + 1, len(which)]
        pieces = [(int(which[a]), encode_filter(tuple(x[a:b] for x in e), h, prefix)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.binary())], ["range", "filter"])

    def run(batches):
        release_cache()
        held: list[Entries] = []
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint32)
                ids = np.zeros(int(codes.max(initial=1)) + 1, np.int64)  # 0: a break or a rare word
                values = batch.column("ids")[i].values
                ids[values.field("pos").to_numpy() + 2] = values.field("id").to_numpy()
                w = ids[codes]
                none = np.zeros(1, np.int64)
                a, b, c = w, np.r_[w[1:], none][:len(w)], np.r_[w[2:], none, none][:len(w)]
                two = (a > 0) & (b > 0)
                three = two & (c > 0)
                held.append(counted(*permuted(np.r_[a[two], a[three]], np.r_[b[two], b[three]], np.r_[np.zeros(int(two.sum()), np.int64), c[three]], bits)))
                n += len(held[-1][0])
                if n > HELD_ENTRIES:
                    held = [merged(held)]
                    n = len(held[0][0])
                    if n > HELD_ENTRIES // 2:
                        yield handed(held[0])
                        held, n = [], 0
        if n:
            yield handed(merged(held))

    return coded.mapInArrow(run, "range bigint, filter binary")


def frequent_phrases(filters: DataFrame, bits: int, prefix: int, min_count: int) -> DataFrame:
    """Merge the filters of each range; (w1, w2, w3, a) of frequent phrases, w3 0 for two words."""
    h = half_bits(bits)

    def run(t: pa.Table) -> pa.Table:
        release_cache()
        at = t.column("range")[0].as_py()
        left, right, n = merged([decode_filter(f, h, prefix, at) for f in t.column("filter").to_pylist()])
        often = n >= min_count
        words = restored(left[often], right[often], bits)
        return pa.table([*(pa.array(x.astype(np.int64)) for x in words), pa.array(n[often])], names=["w1", "w2", "w3", "a"])

    return filters.groupBy("range").applyInArrow(run, "w1 bigint, w2 bigint, w3 bigint, a bigint")


# ------------------------------------------------------------------- mining
def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole decimals: counts below 10^15
    give products below 10^38."""
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in (a, l, r))  # noqa: E741
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 drop_percent: int = DROP_PERCENT, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    prepare(docs.sparkSession)
    texts = docs.select(as_text(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    made = written(chunked(texts), "phrase-chunks")
    spelled = made.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("chunk", "lang", "pos", "x.words", "x.counts")
    often = spelled.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= min_count)
    words = written(running_totals(often, [], ["lang", "word"], "f").select((F.col("before_count") + 1).alias("id"), "lang", "word", "f"), "phrase-words")
    n_ids, n_words = words.count(), int(made.agg(F.sum("n_words")).first()[0] or 0)
    bits = max(1, n_ids.bit_length())
    ranges = max(1, -(-2 * n_words // range_entries))
    prefix = min(half_bits(bits), (ranges - 1).bit_length())

    ids = spelled.join(words.select("lang", F.col("word").alias("words"), "id"), ["lang", "words"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
    coded = made.select("chunk", "codes").join(ids, "chunk").select("codes", "ids")
    phrases = written(frequent_phrases(phrase_filters(coded, bits, prefix), bits, prefix, min_count), "phrases")

    one = words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("x1"), F.col("f").alias("f1"))
    two = words.select(F.col("id").alias("w2"), F.col("word").alias("x2"), F.col("f").alias("f2"))
    pairs = written(phrases.filter("w3 = 0").drop("w3").join(one, "w1").join(two, "w2"), "phrase-pairs")
    first = pairs.select("w1", "w2", "lang", F.concat_ws(" ", "x1", "x2").alias("x12"), "f1", F.col("a").alias("a12"))
    last = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("x2").alias("x3"), F.col("f2").alias("f3"), F.col("a").alias("a23"))
    triples = written(phrases.filter("w3 > 0").join(first, ["w1", "w2"]).join(last, ["w2", "w3"]), "phrase-triples")

    scored_pairs = pairs.select("lang", "w1", "w2", F.concat_ws(" ", "x1", "x2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    scored_pairs = scored_pairs.withColumn("score", score("a", "l", "r"))
    holders = (triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
               .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    kept = scored_pairs.join(holders, ["w1", "w2"], "left").filter(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * drop_percent)
    cut1, cut2 = score("a", "f1", "a23"), score("a", "a12", "f3")
    best = triples.withColumn("s1", cut1).withColumn("s2", cut2)
    early = F.col("s1") <= F.col("s2")
    scored = best.select("lang", F.concat_ws(" ", "x12", "x3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("a12")).alias("l"),
                         F.when(early, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    every = kept.select("lang", "phrase", "a", "l", "r", "score").unionByName(scored)
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    # first the best of each of many parts of a language, so that one large language is no single task
    part = Window.partitionBy("lang", "part").orderBy(*best)
    some = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*best)
    totals = made.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return (some.drop("rank", "part").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
