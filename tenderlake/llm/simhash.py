"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 majority bits of the XXH64 values of a text's word shingles.
Two fingerprints at most ``max_bits`` apart are linked; components give one
class.  Work is done on distinct fingerprints (copies are one row).

Search: the 64 bits are cut into partitions that group correlated bits, and
partition i gets a threshold t_i >= -1 with sum(t_i + 1) = max_bits + 1: two
fingerprints within ``max_bits`` agree up to t_i bits on some partition i.
The thresholds are allocated by dynamic programming on the estimated numbers
of candidates, both from counts over all fingerprints.  Each partition with
t_i >= 0 is probed with every value within t_i bits; candidates are verified
by bit count.

Values that many fingerprints share (more than ``bucket_limit``) make no
pairs.  Their members are linked through the values within one bit of them
instead (for max_bits 2: two fingerprints are at most 2 apart exactly if some
64-bit value is within 1 of both), which takes 65 rows a member.  So no link
is lost and nothing grows with the square of a group.

Defined results: null and empty texts have fingerprint zero and are linked
like others; fewer words than a shingle make one shingle; null ids keep their
fingerprint and get the least id of their component; rows that repeat give a
row each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import as_text, map_batches, utf8, written
from tenderlake.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Numbers of partitions to choose from: 16, 21 or 32 bits each.
N_PARTS = (4, 3, 2)
BUCKET_LIMIT = 200


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and the white space of the contract
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    values = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)]
    h = np.array(values, dtype="<u8")
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        bits += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns of ``keep``: the fingerprint as the
    signed long of the same bits."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle, seed) for t in utf8(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *(batch.column(c) for c in keep)], ["doc_id", "fp", *keep])

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"), *keep), run,
                       ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *keep)))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the 64 x 64 counts of bits set together
    (a task sends one matrix)."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            b = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += b.T @ b
            n += len(b)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j].astype(np.int64)), pa.array(np.full(len(i), n))],
                                             ["cell", "together", "n"])

    rows = (fps.mapInArrow(run, "cell bigint, together bigint, n bigint").groupBy("cell")
            .agg(F.sum("together").alias("together"), F.sum("n").alias("n")).collect())
    m = np.zeros((64, 64))
    for r in rows:  # 2080 rows whatever the input
        i, j = divmod(r["cell"], 64)
        m[i, j] = m[j, i] = r["together"]
    return (rows[0]["n"] if rows else 0), m


def partition_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Group correlated bits: each partition starts with a free bit and takes
    the free bits most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: corr[b][sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b][group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(exact: list[float], agree: list[float], widths: list[int], max_bits: int = MAX_BITS) -> tuple[float, list[int]]:
    """(cost, thresholds): t_i >= -1 with sum(t_i + 1) = max_bits + 1 and the least
    estimated number of candidates.  ``exact``: pairs that agree on the whole
    partition; ``agree``: mean chance that two fingerprints agree on one of
    its bits, which carries the count to t further bits; probing costs a row
    for each value within t bits."""
    from math import comb

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        odds = (1 - agree[i]) / max(agree[i], 1e-9)
        ball = sum(comb(widths[i], k) for k in range(t + 1))
        return exact[i] * sum(comb(widths[i], k) * odds ** k for k in range(t + 1)) + 2.0 * ball

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, max_bits - used + 1):
                new = (c + cost(i, t), [*ts, t])
                if used + t + 1 not in step or new[0] < step[used + t + 1][0]:
                    step[used + t + 1] = new
        best = step
    return best[max_bits + 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, n_parts: tuple[int, ...] = N_PARTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fps``: distinct fingerprints (a written table).  Links (a, b) whose
    components are those of all pairs at most ``max_bits`` apart.

    The counts of every candidate partitioning come from all fingerprints; the
    dynamic program allocates thresholds for each, and the cheapest one is
    taken: more fingerprints ask for wider partitions."""
    n, together = bit_statistics(fps)
    ways = {k: partition_bits(n, together, k) for k in n_parts}
    mask = lambda g: _signed(sum(1 << b for b in g))
    value = F.array(*[F.struct(F.lit(8 * k + i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("value")) for k, parts in ways.items() for i, g in enumerate(parts)])
    sizes = written(fps.select(F.explode(value).alias("k")).groupBy("k.part", "k.value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    # pairs that would have to be verified, by partition; larger buckets take the other way
    counted = {r["part"]: float(r["pairs"]) for r in sizes.groupBy("part").agg(F.sum(F.expr("n * (n - 1) / 2D")).alias("pairs")).collect()}
    p = np.diag(together) / max(n, 1)
    plans = []
    for k, parts in ways.items():
        agree = [float(np.mean(p[g] ** 2 + (1 - p[g]) ** 2)) for g in parts]
        plans.append((*allocate([counted.get(8 * k + i, 0.0) / max(n, 1) for i in range(len(parts))], agree, [len(g) for g in parts], max_bits), k))
    _, thresholds, k = min(plans)
    parts, masks = ways[k], [mask(g) for g in ways[k]]
    sizes = sizes.filter(F.col("part").between(8 * k, 8 * k + 7)).withColumn("part", F.col("part") - 8 * k)

    # probe every value within t_i bits of the partition's own
    probes = []
    for i, (g, m, t) in enumerate(zip(parts, masks, thresholds, strict=True)):
        if t >= 0:
            flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(g, k)]
            probes += [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f)).alias("value")) for f in flips]
    probed = fps.select("fp", F.explode(F.array(*probes)).alias("k")).select("fp", "k.part", "k.value")
    used = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
            for i, (m, t) in enumerate(zip(masks, thresholds, strict=True)) if t >= 0]
    held = fps.select("fp", F.explode(F.array(*used)).alias("k")).select("fp", "k.part", "k.value")
    big = written(sizes.filter(F.col("n") > bucket_limit).select("part", "value"), "simhash-big")
    small = held.join(big, ["part", "value"], "left_anti")
    a, b = probed.alias("a"), small.alias("b")
    pairs = (a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")))
             .filter((F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    # t_i = 0 probes one value: both orders meet there; t_i > 0 probes are symmetric too, so a < b loses nothing
    hot = probed.join(big, ["part", "value"], "left_semi").select("fp").distinct()
    radius = -(-max_bits // 2)
    near = [_signed(sum(1 << x for x in c)) for k in range(radius + 1) for c in combinations(range(64), k)]
    around = hot.select("fp", F.explode(F.array(*[F.lit(x) for x in near])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    low = around.groupBy("value").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m < x")
    if max_bits % 2 == 0:
        stars = around.join(low, "value").filter("fp > m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    else:  # an odd bound: two values a radius away may be one bit too far, so all of the few around a value are compared
        other = around.select("value", F.col("fp").alias("b"))
        stars = (around.select("value", F.col("fp").alias("a")).join(other, "value")
                 .filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b"))
    return pairs.unionAll(stars)


def simhash_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id,
    class_fp (the least fingerprint of its class), and the long columns of ``keep``."""
    d = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed, keep=keep), "simhash-docs")
    fps = written(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    member = written(components(near_links(fps.select("fp"), max_bits)), "simhash-members")
    least = (fps.join(member, fps["fp"] == member["node"]).groupBy("component").agg(F.min("least").alias("component_id")))
    linked = member.join(least, "component").select(F.col("node").alias("fp"), "component_id", F.col("component").alias("class_fp"))
    # one row a fingerprint: alone, its least document is the component; written, so
    # that a hot fingerprint's documents can be split where they are joined
    named = written(fps.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("class_fp", "fp").alias("class_fp")), "simhash-named")
    a, b = d.alias("a"), named.alias("b")
    return a.join(b, F.col("a.fp") == F.col("b.fp")).select(
        "a.doc_id", F.lower(F.lpad(F.hex("a.fp"), 16, "0")).alias("fingerprint"), "b.component_id", "b.class_fp", *[f"a.{c}" for c in keep])
