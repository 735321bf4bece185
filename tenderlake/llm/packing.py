"""Best-fit packing of documents into sequences, with certified bin counts.

1. Tasks tokenise whole texts and cut only documents beyond the capacity.
   Pieces (ids, lengths, checksums; no texts) are written once.
2. Full pieces are sequences by themselves.  The others are dealt to
   partitions of a bounded number of pieces; each partition packs by best-fit
   decreasing and certifies its bin count with a lower bound from
   dual-feasible functions.
3. Partitions whose count exceeds their bound hand all their pieces to the
   next round, the certified ones only those of their emptiest sequence (what
   a cut into partitions wastes).  The pieces of a round are dealt anew and
   packed again; a round is kept if it saves sequences, else the next one
   opens more of the emptiest sequences.  Rounds end when the count meets the
   bound of the whole table, when one partition held all that was exchanged,
   or after ``MAX_ROUNDS``.

Defined results: a null or empty text is one piece of length 1 (the end id);
null ids and rows that repeat are documents of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import chunks, utf8, written
from tenderlake.llm.tokens import TOKENIZER, token_ids

CAPACITY = 2048
#: Pieces that one task packs.
PARTITION_PIECES = 30_000
MAX_ROUNDS = 6
PIECES = "rid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", part bigint, bin bigint, offset bigint, fill bigint, n_bins bigint, bound bigint"


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                     capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row a piece.  ``rid`` numbers the pieces by task and place, which a
    task that runs again repeats."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        rid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in chunks(whole, text_col):
                rows = []
                for doc, ids in zip(batch.column(id_col).to_pylist(), token_ids(tokenizer).encode(utf8(batch, text_col)), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at:at + step]
                        rows.append((rid, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                        rid += 1
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length (to be given in decreasing order), and
    the number of bins.  ``open_at[r]`` stacks the bins with r places left;
    the set bits of ``mask`` are the r that have any."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, size in enumerate(lengths.tolist()):
        above = mask >> size
        if above:
            left = (above & -above).bit_length() - 1 + size
            at = open_at[left]
            b = at.pop()
            if not at:
                mask ^= 1 << left
        else:
            b, left = n, capacity
            n += 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            if not open_at[left]:
                mask |= 1 << left
            open_at[left].append(b)
    return bins, offsets, n


def dual_feasible_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins that the lengths need: ``counts[x]`` of length x.

    Largest of the sums of f(x) over the dual-feasible functions
    f_t (lengths over capacity - t count whole, those under t not, others by
    their share), u_k (floors of (k + 1) x / capacity over k, exact shares
    kept), and u_k after f_t.
    """
    x = np.arange(len(counts))
    have = counts > 0
    x, c = x[have], counts[have].astype(np.int64)
    if not len(x):
        return 0
    best = -(-int((x * c).sum()) // capacity)
    for t in range(1, capacity // 2 + 1, max(1, capacity // 512)):
        fx = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((fx * c).sum()) // capacity))
        if t % 64 == 1:
            for k in range(1, 8):
                whole = (fx * (k + 1)) % capacity == 0
                scaled = np.where(whole, fx * k, fx * (k + 1) // capacity * capacity)  # times k * capacity
                best = max(best, -(-int((scaled * c).sum()) // (k * capacity)))
    return best


def pack_partitions(pieces: DataFrame, n_parts: int, salt: int, capacity: int) -> DataFrame:
    """Deal the pieces to ``n_parts`` partitions and pack each."""
    def pack(key, table):
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("rid").to_numpy(), -length))
        table, length = table.take(pa.array(order)), length[order]
        bins, offsets, n = best_fit_decreasing(length, capacity)
        fill = np.bincount(bins, weights=length, minlength=n).astype(np.int64)
        bound = dual_feasible_bound(np.bincount(length, minlength=capacity + 1), capacity)
        # bins numbered from the fullest: the last one is the emptiest
        rank = np.empty(n, np.int64)
        rank[np.argsort(-fill, kind="stable")] = np.arange(n)
        rows = table.num_rows
        for name, v in (("bin", rank[bins]), ("offset", offsets), ("fill", fill[bins]), ("n_bins", np.full(rows, n)), ("bound", np.full(rows, bound))):
            table = table.append_column(name, pa.array(v, pa.int64()))
        return table

    cols = [c.split()[0] for c in PIECES.split(", ")]
    return (pieces.select(*cols, F.pmod(F.xxhash64(F.lit(salt), "rid"), F.lit(n_parts)).alias("part"))
            .groupBy("part").applyInArrow(pack, PACKED))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                   capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(tokenised_pieces(docs, id_col, text_col, tokenizer, capacity), "pack-pieces")
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    pool = pieces.filter(F.col("length") < capacity)
    total = pool.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    need = -(-total["tokens"] // capacity)

    def parts_of(n: int) -> int:
        return max(1, -(-n // partition_pieces))

    def stats(df: DataFrame) -> tuple[int, int]:
        per_part = df.groupBy("part").agg(F.max("n_bins").alias("n_bins"), F.max("bound").alias("bound"))
        r = per_part.agg(F.coalesce(F.sum("n_bins"), F.lit(0)), F.coalesce(F.sum(F.expr("int(n_bins > bound)")), F.lit(0))).first()
        return r[0], r[1]

    n_parts = parts_of(total["n"])
    current = written(pack_partitions(pool, n_parts, 0, capacity), "pack-round")
    bins, _ = stats(current)
    settled = []  # what earlier rounds placed and later rounds leave in place
    kept_bins, width, widest = 0, 1, 0

    def rows(df: DataFrame, level: int) -> DataFrame:
        return df.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.lit(level << 56) + F.col("part") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")

    for level in range(1, max_rounds + 1):
        if kept_bins + bins <= need or n_parts == 1 or width > 2 * widest > 0:
            break
        leaves = (F.col("n_bins") > F.col("bound")) | (F.col("bin") >= F.col("n_bins") - width)
        leaving = current.filter(leaves)
        count = leaving.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part", "bin").alias("b"), F.max("n_bins").alias("w")).first()
        n_next, widest = parts_of(count["n"]), count["w"]
        trial = written(pack_partitions(leaving, n_next, level, capacity), "pack-round")
        trial_bins, _ = stats(trial)
        if trial_bins >= count["b"]:
            width *= 4  # more sequences are opened again
            continue
        settled.append(rows(current.filter(~leaves), len(settled)))
        kept_bins += bins - count["b"]
        current, bins, n_parts, width, widest = trial, trial_bins, n_next, 1, 0
    out = full.unionByName(rows(current, len(settled)))
    for s in settled:
        out = out.unionByName(s)
    return out
