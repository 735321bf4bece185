"""Removal of long repeated byte strings with a logarithmic family of sparse
suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else, in any document.

Anchors: of the ``head``-byte strings inside a window of ``length`` bytes the
one with the least hash (leftmost) is the window's anchor.  Equal windows
have their anchors at equal places, and neighbouring windows share theirs, so
one anchor in about 170 bytes stands for all windows.  The suffixes that start
at anchors are the ones a (sparse) suffix array holds; an entry is sorted by
the hash of its first ``head`` bytes, then by the hash of its context, the
bytes that the anchor's windows cover.  Only equality of long prefixes
matters here, so the order is that of hashes, not of letters.  Entries of
equal contexts are one entry with a count: groups of copies never grow.

Index family: documents come in batches.  A batch's array is merge-scanned
(sort-merge join on the head) against itself and every level of the index, which
gives the heads that occur more than once; then it enters the index, and while
the next level is taken, the two are merged into one of twice the size.  A
batch is thus rewritten a logarithmic number of times.

Contexts with a count over 1 repeat as a whole.  Different contexts with the
same head are compared by longer and longer strings.  The places of the head in
a window are cut into intervals.  All windows of one interval hold the same
bytes around the head, the interval's core; a context's own windows of the
interval together cover its hull.  Contexts that differ in the core share no
window of the interval.  Contexts with equal hulls share all of them, and one of
them stands for all.  What is left, equal cores with different hulls, goes on
with the interval's parts, until an interval is one place and the hull is the
window.  Contexts are counted by grouped aggregates with two rows each at the
first level, so that no group is ever gathered, whatever shares a head.

Hashes have 64 bits; two windows count as equal if the hashes of their heads,
their places and the hashes of all their bytes agree.

Defined results: a null text counts as the empty one; documents shorter than
``length`` lose nothing; rows that repeat and null ids are documents of their
own (so a repeated long text loses all its bytes); an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import as_text, drop_written, release_cache, utf8, written

LENGTH = 400
HEAD = 64
BATCHES = 4
SEED = 7
#: Bytes that a task hashes at once (positions take 24 bits).
SEGMENT = 1 << 19
#: Contexts that a task hashes at once.
TASK_ROWS = 2_000

ENTRY = ["key", "ctx", "left", "span"]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(b: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, b, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substring of a byte array, by prefix sums modulo 2^64."""

    def __init__(self, seed: int = SEED):
        self.table = np.random.default_rng(seed).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(BASE, 1), _powers(INVERSE, 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            n = len(data) + 1
            self.up, self.down = _powers(BASE, n), _powers(INVERSE, n)
        p = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:len(data)], out=p[1:])
        return p

    def hashes(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((p[end] - p[start]) * self.down[start])


_ROLLING: dict[int, Rolling] = {}


def rolling(seed: int = SEED) -> Rolling:
    if seed not in _ROLLING:
        _ROLLING[seed] = Rolling(seed)
    return _ROLLING[seed]


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n, rows = len(x), -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    padded = padded.reshape(rows, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


def anchors(texts: list[bytes], length: int = LENGTH, head: int = HEAD, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchors of the texts (in all less than 2^24 bytes): text, anchor, first
    and last window start, head hash, context hash.  Windows of one anchor
    that do not follow each other are entries of their own."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    start = end - size
    n = len(data)
    none = np.zeros(0, np.int64)
    if not (size >= length).any():
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    r = rolling(seed)
    p = r.prefix(data)
    at = np.arange(n - head + 1)
    h = r.hashes(p, at, at + head)
    key = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    least = (_sliding_least(key, length - head + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.full(n - length + 1, -1, np.int64)
    for i in np.flatnonzero(size >= length):
        text[start[i]:end[i] - length + 1] = i
    s = np.flatnonzero(text >= 0)
    a, d = least[s], text[s]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    lo, hi = s[new], s[np.r_[new[1:] - 1, len(s) - 1]]
    a, d = a[new], d[new]
    return d, a - start[d], lo - start[d], hi - start[d], h[a], r.hashes(p, lo, hi + length)


def text_anchors(text: bytes, length: int, head: int, seed: int, segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """Anchors of one text of any size: segments overlap by all but one byte of a window."""
    parts = []
    for at in range(0, max(1, len(text) - length + 1), segment):
        _, a, lo, hi, key, ctx = anchors([text[at:at + segment + length - 1]], length, head, seed)
        parts.append((a + at, lo + at, hi + at, key, ctx))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values).cast(kind))


def scanned(docs: DataFrame, length: int, head: int, seed: int) -> DataFrame:
    """A row a document: a number (by task and place, which a task that runs
    again repeats), id, digest, bytes, SHA-256, and the anchors as lists."""
    def run(batches):
        release_cache()
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column("doc_id"), utf8(batch)
            at = 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and (to == at or total + len(texts[to]) <= SEGMENT):
                    total += len(texts[to])
                    to += 1
                part = texts[at:to]
                if total > SEGMENT + length:
                    a, lo, hi, key, ctx = text_anchors(part[0], length, head, seed)
                    counts = np.array([len(a)])
                else:
                    d, a, lo, hi, key, ctx = anchors(part, length, head, seed)
                    counts = np.bincount(d, minlength=len(part))
                sha = [hashlib.sha256(t).digest() for t in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + to - at)), ids.slice(at, to - at), pa.array([x[:16] for x in sha], pa.binary()), pa.array([len(t) for t in part], pa.int64()),
                     pa.array([x.hex() for x in sha]), _lists(counts, key.view(np.int64), pa.int64()), _lists(counts, ctx.view(np.int64), pa.int64()),
                     _lists(counts, lo, pa.int64()), _lists(counts, a - lo, pa.int32()), _lists(counts, hi - lo, pa.int32())],
                    ["rid", "doc_id", "digest", "n_bytes", "sha256", "key", "ctx", "lo", "left", "span"])
                rid, at = rid + to - at, to
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "rid bigint, doc_id bigint, digest binary, n_bytes bigint, sha256 string, key array<bigint>, ctx array<bigint>, "
                                "lo array<bigint>, left array<int>, span array<int>")


def _entries(scan: DataFrame) -> DataFrame:
    return scan.select("rid", F.explode(F.arrays_zip("key", "ctx", "left", "span", "lo")).alias("e")).select("rid", "e.*")


#: A place in a document as one number, so that its minimum is a hash aggregate.
PLACE = 1 << 40


def _place(rid: str, lo: str):
    return F.col(rid).cast("decimal(38,0)") * F.lit(PLACE).cast("decimal(14,0)") + F.col(lo)


def suffix_array(entries: DataFrame) -> DataFrame:
    """Entries with their counts and one place each, sorted by head and context."""
    return (entries.groupBy(*ENTRY).agg(F.sum("n").alias("n"), F.min("place").alias("place")).sortWithinPartitions("key", "ctx"))


class IndexFamily:
    """Levels of sorted arrays, of 1, 2, 4, ... batches."""

    def __init__(self) -> None:
        self.levels: list[DataFrame | None] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Add a batch; returns the heads that it repeats or shares with the index."""
        array = written(suffix_array(entries), "suffix-array")
        shared = array.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
        for level in self.levels:
            if level is not None:
                shared = shared.unionAll(array.join(level.select("key"), "key", "left_semi").select("key"))
        shared = written(shared.distinct(), "suffix-shared")
        for i, level in enumerate(self.levels):
            if level is None:
                self.levels[i] = array
                return shared
            merged = written(suffix_array(level.unionByName(array)), "suffix-array")
            drop_written(level)
            drop_written(array)
            self.levels[i], array = None, merged
        self.levels.append(array)
        return shared

    def entries(self) -> DataFrame:
        out = None
        for level in self.levels:
            if level is not None:
                out = level if out is None else out.unionByName(level)
        return out


def interval_steps(length: int, head: int) -> list[int]:
    """Places in an interval, by level: two intervals first, one place last."""
    places = length - head + 1
    small = max(1, round((places / 2) ** 0.5))
    large = -(-(places + 1) // 2 // small) * small
    return list(dict.fromkeys((large, small, 1)))


INTERVAL = "cid bigint, part int, first int, last int, core bigint, hull bigint"


def interval_hashes(contexts: DataFrame, step: int, parent: int | None, length: int, head: int, seed: int) -> DataFrame:
    """The intervals of ``step`` places of every context (cid, key, left, span,
    body; with ``parent``, only those inside its intervals ``parts`` of that
    size): its windows there, first to last, and the hashes of core and hull."""
    def rows(batches):
        release_cache()
        r = rolling(seed)
        for t in (b.slice(i, TASK_ROWS) for b in batches for i in range(0, b.num_rows, TASK_ROWS)):
            body = t.column("body").to_pylist()
            data = np.frombuffer(b"".join(body), np.uint8)
            start = np.r_[0, np.cumsum([len(x) for x in body])[:-1]].astype(np.int64)
            left, span = (t.column(c).to_numpy().astype(np.int64) for c in ("left", "span"))
            key, cid = t.column("key").to_numpy().view(np.uint64), t.column("cid").to_numpy()
            row, low, high = np.arange(len(body)), left - span, left
            if parent is not None:
                lists = t.column("parts")
                row = np.repeat(row, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                at = lists.flatten().to_numpy().astype(np.int64) * parent
                low, high = np.maximum(low[row], at), np.minimum(high[row], at + parent - 1)
            n = high // step - low // step + 1
            part = np.repeat(low // step, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, low, high = (np.repeat(x, n) for x in (row, low, high))
            low, high = np.maximum(low, part * step), np.minimum(high, part * step + step - 1)
            end = np.minimum(part * step + step - 1, length - head)
            p, a = r.prefix(data), start[row] + left[row]
            label = _mix(key[row] * BASE + part.astype(np.uint64))
            core = r.hashes(p, a - part * step, a + length - end) ^ label
            hull = r.hashes(p, a - high, a - low + length) ^ _mix(label + (low * length + high).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[row]), pa.array(part.astype(np.int32)), pa.array((left[row] - high).astype(np.int32)), pa.array((left[row] - low).astype(np.int32)),
                 pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))], [x.split()[0] for x in INTERVAL.split(", ")])

    return contexts.mapInArrow(rows, INTERVAL)


def repeated_windows(contexts: DataFrame, length: int, head: int, seed: int) -> DataFrame:
    """(cid, first, last): runs of windows of a context that another context
    of its head has at the same places; rows of ``contexts`` may repeat."""
    out, parent = None, None
    steps = interval_steps(length, head)
    for step in steps:
        rows = written(interval_hashes(contexts, step, parent, length, head, seed), "suffix-intervals")
        hulls = written(rows.groupBy("core", "hull", "part").agg(F.min("cid").alias("cid"), F.max("cid").alias("other")), "suffix-hulls")
        equal = hulls.filter("cid <> other").select("core", "hull")
        found = written(rows.join(equal, ["core", "hull"], "left_semi").select("cid", "first", "last"), "suffix-runs")
        out = found if out is None else out.unionByName(found)
        drop_written(rows)
        if step != steps[-1]:
            mixed = hulls.groupBy("core").agg(F.min("hull").alias("a"), F.max("hull").alias("b")).filter("a <> b").select("core")
            onward = hulls.join(mixed, "core", "left_semi").groupBy("cid").agg(F.collect_set("part").alias("parts"))
            # the few that go on, with their bytes
            contexts = written(contexts.drop("parts").join(onward, "cid"), "suffix-onward")
        drop_written(hulls)
        parent = step
    return out


def fetched(docs: DataFrame, wanted: DataFrame, schema: str, cut) -> DataFrame:
    """``cut(text, row)`` over the texts of ``wanted`` (digest, doc_id, and
    lists), one row of every group of copies."""
    a, b = docs.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)).alias("a"), wanted.alias("b")
    both = a.join(b, (F.col("a.digest") == F.col("b.digest")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select(
        "a.text", *[f"b.{c}" for c in wanted.columns if c != "doc_id"])
    return both.mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, head: int = HEAD,
                   batches: int = BATCHES, seed: int = SEED) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    scan = written(scanned(docs, length, head, seed), "suffix-scan")
    family, shared = IndexFamily(), None
    for b in range(batches):
        batch = _entries(scan.filter(F.pmod(F.xxhash64("digest"), F.lit(batches)) == b)).select(
            *ENTRY, F.lit(1).cast("bigint").alias("n"), _place("rid", "lo").cast("decimal(38,0)").alias("place"))
        more = family.add(batch)
        shared = more if shared is None else shared.unionAll(more)
    found = written(family.entries().join(shared.distinct(), "key", "left_semi").groupBy(*ENTRY).agg(
        F.sum("n").alias("n"), F.min("place").alias("place")), "suffix-found")
    for level in family.levels:
        if level is not None:
            drop_written(level)

    # heads with different contexts: fetch one text for each context
    heads = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "suffix-heads")
    reps = written(scan.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "suffix-reps")
    rid = F.floor(F.col("place") / F.lit(PLACE).cast("decimal(14,0)")).cast("bigint")
    unclear = found.join(heads, "key").select(
        *ENTRY, rid.alias("rid"), (F.col("place") % F.lit(PLACE).cast("decimal(14,0)")).cast("bigint").alias("lo"))
    unclear = unclear.groupBy("rid").agg(F.collect_list(F.struct(F.xxhash64(*ENTRY).alias("cid"), "key", "left", "span", "lo")).alias("e")).join(scan.select("rid", "digest"), "rid").drop("rid")
    wanted = unclear.join(reps, "digest")

    def contexts(batches):
        for batch in batches:
            rows = []
            for text, entries in zip(utf8(batch), batch.column("e").to_pylist(), strict=True):
                rows += [(e["cid"], e["key"], e["left"], e["span"], text[e["lo"]:e["lo"] + e["span"] + length]) for e in entries]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                             ["cid", "key", "left", "span", "body"])

    bodies = written(fetched(docs, wanted, "cid bigint, key bigint, left int, span int, body binary", contexts), "suffix-bodies")
    runs = repeated_windows(bodies, length, head, seed).groupBy("cid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    whole = found.filter("n > 1").select(F.xxhash64(*ENTRY).alias("cid"), F.array(F.struct(F.lit(0).alias("first"), F.col("span").alias("last"))).alias("runs"))
    hits = written(whole.unionByName(runs.join(whole, "cid", "left_anti")), "suffix-hits")
    drop_written(bodies)

    # back to the documents: runs of window starts
    # one row a text
    texts = scan.join(scan.groupBy("digest").agg(F.min("rid").alias("rid")).select("rid"), "rid", "left_semi")
    starts = (_entries(texts).withColumn("cid", F.xxhash64(*ENTRY)).join(hits, "cid").select("rid", F.explode(F.transform("runs", lambda r: F.struct(
        (F.col("lo") + r["first"]).alias("first"), (F.col("lo") + r["last"]).alias("last")))).alias("r"))
        .groupBy("rid").agg(F.collect_list("r").alias("r")))
    gone = written(starts.join(scan.select("rid", "digest"), "rid").drop("rid").join(reps, "digest"), "suffix-gone")

    def cut(batches):
        for batch in batches:
            rows = []
            for text, digest, r in zip(utf8(batch), batch.column("digest").to_pylist(), batch.column("r").to_pylist(), strict=True):
                kept, at, spans, removed = [], 0, 0, 0
                for first, last in sorted((x["first"], x["last"]) for x in r):
                    end = last + length
                    if first > at or not spans:
                        kept.append(text[at:first])
                        spans, removed, at = spans + 1, removed + end - first, end
                    elif end > at:
                        removed, at = removed + end - at, end
                kept.append(text[at:])
                rows.append((digest, removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                             ["digest", "n_removed", "n_spans", "kept_sha256"])

    # rows of documents that repeat would be cut twice
    changed = written(fetched(docs, gone, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string", cut).dropDuplicates(["digest"]), "suffix-cut")
    a, b = scan.select("doc_id", "digest", "n_bytes", "sha256").alias("a"), changed.alias("b")
    zero = F.lit(0).cast("bigint")
    return a.join(b, F.col("a.digest") == F.col("b.digest"), "left").select(
        "a.doc_id", "a.n_bytes", F.coalesce("b.n_removed", zero).alias("n_removed"), F.coalesce("b.n_spans", zero).alias("n_spans"),
        F.coalesce("b.kept_sha256", "a.sha256").alias("kept_sha256"), (F.col("a.n_bytes") - F.coalesce("b.n_removed", zero)).alias("n_kept"))
