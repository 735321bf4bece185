"""Exact k-NN over lanes of requests and streamed documents.

Requests of a blocking key are dealt to lanes of bounded size by a hash of their
id; a key's documents go once to each of its lanes.  A lane holds its requests'
vectors and their best rows so far, and its documents stream past in tiles, so a
task needs the same memory whatever the size of a key, a hot key is as many lanes
as its size and its share of the work ask for, and only ≤ k rows a request leave,
already ranked.  Documents move once a lane, not once a small block, and lanes are
as many as the cluster's cores can use, not as the table has partitions, so that
what moves grows with the documents; lanes of large keys are dealt to tasks in turn.

In a tile one single-precision matrix product gives a lower bound of every
distance (rounding noise subtracted).  What may lie inside the similarity cut and
the k best so far is computed again in double precision, term by term in the
order of ``functions.vectors.distance``, and cut exactly.  So rows carry the same
distances as the join kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tenderlake.operators.blocks import checked_broadcast
from tenderlake.session import written

REQUEST_BLOCK = 1 << 17
CORPUS_BLOCK = 4096
#: Best rows a lane holds at most (requests x k), so that its memory is bounded.
HELD_ROWS = 1 << 21
#: Requests compared with a tile of documents in one product (a tile stays in a core's cache).
PRODUCT_ROWS = 256
#: Exact distances a request in a tile that cost as much as finding its k-th bound.
SPARED = 64
#: Pairs whose exact distances are computed at once.
PAIR_ROWS = 1024
#: Lanes a core has, all keys together, where sizes of lanes do not ask for more.
LANES_PER_CORE = 2
#: Requests a lane has at least, where more lanes are only made to use more tasks.
LEAST_LANE = 256
#: Any k from here on stands for all rows inside the cut.
UNLIMITED = 1 << 31


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    """Vectors in the precision they came in; sums are taken in double precision."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _left_sum(terms: np.ndarray) -> np.ndarray:
    """Sums of columns, row after row."""
    acc = terms[0].copy()
    for t in terms[1:]:
        acc += t
    return acc


def exact_distance(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of row pairs, summed left to right like the Spark expression.
    Rows are taken in parts whose components, side by side, stay in a core's cache."""
    at = range(0, len(q), PAIR_ROWS)
    return np.concatenate([_distances(metric, q[i:i + PAIR_ROWS], v[i:i + PAIR_ROWS]) for i in at]) if len(q) else np.zeros(0)


def _distances(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    q, v = (np.ascontiguousarray(x.T).astype(np.float64, copy=False) for x in (q, v))
    if metric in ("l2sq", "l2"):
        diff = q - v
        diff *= diff
        d = _left_sum(diff)
        return np.sqrt(d) if metric == "l2" else d
    dot = _left_sum(q * v)
    if metric == "ip":
        return 1.0 - dot
    den = np.sqrt(_left_sum(q * q)) * np.sqrt(_left_sum(v * v))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den == 0, 1.0, 1.0 - dot / den)


class _Space:
    """Lower bounds of distances as one product: rows of both sides get columns
    of their own, the rounding noise of ``dim`` terms is subtracted."""

    def __init__(self, metric: str, dim: int):
        self.metric, self.slack = metric, 2.4e-7 * (dim + 8)

    def norms(self, x: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return np.zeros(len(x))
        return np.einsum("ij,ij->i", x, x, dtype=np.float64)

    def sides(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        n, one = self.norms(x)[:, None], np.ones((len(x), 1))
        if self.metric in ("l2sq", "l2"):
            n = n * (1.0 - self.slack)
            out = np.hstack([-2.0 * x, n - self.slack, one]) if query else np.hstack([x, one, n])
        elif self.metric == "ip":
            n = n * (-0.5 * self.slack)
            out = np.hstack([-x, n + (1.0 - self.slack), one]) if query else np.hstack([x, one, n])
        else:
            size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = np.where(size == 0, 0.0, x / size)
            out = np.hstack([-x, one * (1.0 - self.slack)]) if query else np.hstack([x, one])
        # beyond single precision the product is taken in double precision
        return out.astype(np.float32) if not len(out) or np.nanmax(np.abs(out), initial=0.0) < 1e15 else out

    def order(self, distance: np.ndarray) -> np.ndarray:
        """Distances as the product orders them (l2: squared)."""
        return distance * distance * (1.0 + 1e-12) if self.metric == "l2" else distance


class _Lane:
    """Requests of a lane, and their best rows among the documents seen."""

    def __init__(self, make: "_Kernel"):
        self.make, self.parts, self.table, self.carried = make, [], None, []

    def ask(self, requests: pa.RecordBatch) -> None:
        self.parts.append(requests)

    def _begin(self) -> None:
        m = self.make
        t = pa.Table.from_batches(self.parts)
        self.q = _matrix(t, "_v", m.dim)
        self.parts, self.table = [], t.drop_columns(["_v"])  # the matrix holds the vectors
        self.min_sim = t.column("min_similarity").to_numpy().astype(np.float64)
        ids = t.column("query_id").combine_chunks().dictionary_encode()
        self.group = ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        if m.by_row:
            self.group = np.arange(t.num_rows)
        self.groups = int(self.group.max()) + 1
        limit = 1.0 - self.min_sim
        self.cut = np.where(self.min_sim > 0, m.space.order(limit), np.inf)
        parts = [self.q[i:i + 8192] for i in range(0, len(self.q), 8192)]
        self.left = np.concatenate([m.space.sides(x, True) for x in parts])
        self.norm = np.concatenate([m.space.norms(x) for x in parts])
        self.tests = [t_.requests(t) for t_ in m.tests]
        self.reach = np.full(self.groups, np.inf)
        self.rows: list = []
        self.waiting = self.kept = 0

    def meet(self, corpus: pa.Table):
        if self.table is None:
            if not self.parts:  # no request was dealt to this lane
                return
            self._begin()
        m = self.make
        v = _matrix(corpus, "_v", m.dim)
        right, far = np.ascontiguousarray(m.space.sides(v, False).T), m.space.norms(v)
        far = float(np.nanmax(far, initial=0.0))
        tests = [t.corpus(corpus, held) for t, held in zip(m.tests, self.tests, strict=True)]
        ids = corpus.column("doc_id").to_numpy()
        found = []
        for at in range(0, len(self.q), PRODUCT_ROWS):
            part = slice(at, at + PRODUCT_ROWS)
            low = self.left[part] @ right
            reach = np.minimum(self.cut[part], m.space.order(self.reach[self.group[part]]))
            with np.errstate(over="ignore"):
                reach = np.nextafter(reach.astype(low.dtype), low.dtype.type(np.inf))
            ok = low <= reach[:, None]
            masked = False
            if m.k < low.shape[1] and np.count_nonzero(ok) > (m.k + SPARED) * len(low):
                for t in tests:
                    ok &= t(part)
                masked = True
                near = np.partition(np.where(ok, low, low.dtype.type(np.inf)), m.k - 1, axis=1)[:, m.k - 1]
                ok &= low <= (near + 2.0 * m.space.slack * (1.0 + self.norm[part] + far) * 1.001)[:, None]
            qi, ci = np.divmod(np.flatnonzero(ok), low.shape[1])  # many times faster than a matrix's nonzero
            qi += at
            for t in () if masked else tests:
                keep = t.pairs(qi, ci)
                qi, ci = qi[keep], ci[keep]
            for i in range(0, len(qi), 1 << 16):  # bounded gathers
                a, b = qi[i:i + (1 << 16)], ci[i:i + (1 << 16)]
                d = exact_distance(m.metric, self.q[a], v[b])
                good = (np.maximum(0.0, 1.0 - d) >= self.min_sim[a]) & (d <= self.reach[self.group[a]])
                found.append((a[good].astype(np.int32), b[good].astype(np.int32), d[good]))
            if m.k >= UNLIMITED:
                yield from self._all(found, corpus)
                found = []
            elif sum(len(f[0]) for f in found) > HELD_ROWS // 4:
                self._hold(found, corpus, ids)
                found = []
        if found:
            self._hold(found, corpus, ids)

    def _all(self, found: list, corpus: pa.Table):
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        for i in range(0, len(a), 1 << 16):
            p = slice(i, i + (1 << 16))
            yield self.make.batch(self.table.take(pa.array(a[p])), corpus.take(pa.array(b[p])), d[p], np.zeros(len(a[p]), np.int32))

    def _hold(self, found: list, corpus: pa.Table, ids: np.ndarray) -> None:
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(a):
            return
        used, place = np.unique(b, return_inverse=True)
        base = sum(t.num_rows for t in self.carried)
        self.carried.append(corpus.select(self.make.carry).take(pa.array(used)))
        self.rows.append((a, d, ids[b], (place + base).astype(np.int32)))
        self.waiting += len(a)
        if self.kept == 0 or self.waiting > max(1 << 16, self.kept):
            self._best()

    def _best(self) -> None:
        a, d, ids, at = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        g = self.group[a]
        order = np.lexsort((ids, d, g))
        g = g[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        first = place < self.make.k
        last = place == self.make.k - 1
        self.reach[g[last]] = d[order[last]]
        order = order[first]
        a, d, ids, at = a[order], d[order], ids[order], at[order]
        used, at = np.unique(at, return_inverse=True)
        self.carried = [pa.concat_tables(self.carried).take(pa.array(used))]
        self.rows, self.rank = [(a, d, ids, at.astype(np.int32))], place[first] + 1
        self.kept, self.waiting = len(a), 0

    def finish(self):
        if self.table is None or self.make.k >= UNLIMITED or not self.rows:
            return
        self._best()
        a, d, _, at = self.rows[0]
        for i in range(0, len(a), 1 << 16):
            p = slice(i, i + (1 << 16))
            yield self.make.batch(self.table.take(pa.array(a[p])), self.carried[0].take(pa.array(at[p])), d[p], self.rank[p].astype(np.int32))


class _Domains:
    """Test of pairs: the document's domain is among those the request asks for."""

    def requests(self, table: pa.Table):
        return table.column("_doms").to_pylist()

    def corpus(self, table: pa.Table, wanted: list):
        names = table.column("domaine_technique").combine_chunks().dictionary_encode()
        known = {x: i for i, x in enumerate(names.dictionary.to_pylist())}
        allowed = np.ones((len(wanted), len(known) + 1), bool)  # the last column: no domain
        for i, some in enumerate(wanted):
            if some:
                allowed[i] = False
                allowed[i, [known[w] for w in some if w in known]] = True
        return _Allowed(allowed, names.indices.fill_null(len(known)).to_numpy(zero_copy_only=False))


class _Allowed:
    def __init__(self, allowed: np.ndarray, code: np.ndarray):
        self.allowed, self.code = allowed, code

    def __call__(self, part: slice) -> np.ndarray:
        return self.allowed[part][:, self.code]

    def pairs(self, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        return self.allowed[qi, self.code[ci]]


class _Signatures:
    """Test of pairs: at least one signature (a number a band) in common."""

    def requests(self, table: pa.Table):
        return self._numbers(table)

    def corpus(self, table: pa.Table, mine: np.ndarray):
        return _Shared(mine, self._numbers(table))

    def _numbers(self, table: pa.Table) -> np.ndarray:
        x = table.column("_sigs").combine_chunks()
        return x.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


class _Shared:
    def __init__(self, mine: np.ndarray, other: np.ndarray):
        self.mine, self.other = mine, other

    def __call__(self, part: slice) -> np.ndarray:
        q, c = self.mine[part], self.other
        out = np.zeros((len(q), len(c)), bool)
        for band in range(q.shape[1]):
            out |= q[:, band, None] == c[None, :, band]
        return out

    def pairs(self, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qi), bool)
        for band in range(self.mine.shape[1]):
            out |= self.mine[qi, band] == self.other[ci, band]
        return out


class _Kernel:
    """Rows of lanes, sorted by lane and side (requests first), to ranked rows."""

    def __init__(self, dim: int, metric: str, k: int, tests: list, out: T.StructType, block: int):
        self.dim, self.metric, self.k, self.tests, self.block = dim, metric, k, tests, block
        self.space = _Space(metric, dim)
        self.out = out
        self.carry = [f.name for f in out.fields[4:-1]]
        self.by_row = any(isinstance(t, _Signatures) for t in tests)

    def batch(self, requests: pa.Table, corpus: pa.Table, distance: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        cols = [requests.column(c) for c in ("query_id", "limit", "min_similarity")] + [pa.array(distance)]
        cols += [corpus.column(c) for c in self.carry] + [pa.array(rank)]
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
        schema = to_arrow_schema(self.out)
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def __call__(self, batches):
        name = lane = None
        for rb in batches:
            cell = rb.column("_cell").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            side = rb.column("_side").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]) if len(cell) else []
            for i, j in zip(starts, [*starts[1:], len(cell)], strict=True):
                own = rb.column("_cell")[int(i)].as_py()
                if own != name:
                    if lane is not None:
                        yield from lane.finish()
                    name, lane = own, _Lane(self)
                rows = rb.slice(int(i), int(j - i))
                if side[i] == 0:
                    lane.ask(rows)
                else:
                    for at in range(0, rows.num_rows, self.block):
                        yield from lane.meet(pa.Table.from_batches([rows.slice(at, self.block)]))
        if lane is not None:
            yield from lane.finish()


def lanes_and_tasks(df: DataFrame) -> tuple[int, int]:
    """(lanes that keep the cluster's cores busy, partitions of the lanes' shuffle)."""
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        lanes = LANES_PER_CORE * spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001  (a remote session)
        lanes = shuffled
    return lanes, max(lanes, shuffled)


def deal(requests: DataFrame, corpus: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """(requests, corpus, tasks): rows of a key dealt to lanes of at most about
    ``block`` requests, with their ``_task``, ``_cell`` (key and lane) and ``_side`` (0, 1)."""
    one = F.count(F.lit(1))
    sizes = written(requests.groupBy("_key").agg(one.alias("_l")).join(corpus.groupBy("_key").agg(one.alias("_r")), "_key"), "block-sizes")
    work = F.col("_l").cast("double") * F.col("_r")
    total = sizes.agg(F.sum(work)).first()[0] or 1.0
    busy, tasks = lanes_and_tasks(corpus)
    spread = F.least(F.ceil(F.col("_l") / LEAST_LANE), F.ceil(work / F.lit(total) * busy))
    lanes = sizes.select("_key", work.alias("_w"), F.greatest(F.ceil(F.col("_l") / block), spread).cast("bigint").alias("_n"))
    # lanes of large keys (few: each has a share of the work or fills a lane) go to tasks in turn, a small key by its hash
    large = F.col("_n") > 1
    turn = Window.partitionBy(F.when(~large, F.col("_key"))).orderBy(F.col("_w").desc(), "_key")
    first = F.when(large, F.sum("_n").over(turn) - F.col("_n")).otherwise(F.pmod(F.xxhash64("_key"), F.lit(tasks)))
    lanes = checked_broadcast(lanes.select("_key", "_n", first.alias("_first")))
    task = F.pmod(F.col("_first") + F.col("_lane"), F.lit(tasks)).cast("int").alias("_task")
    cell = F.concat(F.col("_key"), F.lit("\x1f"), F.col("_lane").cast("string")).alias("_cell")
    asked = requests.join(lanes, "_key").withColumn("_lane", F.pmod(F.xxhash64("query_id"), F.col("_n")))
    asked = asked.select(task, cell, F.lit(0).alias("_side"), *requests.columns)
    lanes = lanes.select(*[F.col(c).alias(c) for c in lanes.columns])  # columns of its own for the other side
    dealt = corpus.join(lanes, "_key").withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return asked, dealt.select(task, cell, F.lit(1).alias("_side"), *corpus.columns), tasks


def block_candidates(requests: DataFrame, corpus: DataFrame, dim: int, metric: str, k: int, domain_filter: bool,
                     request_block: int = REQUEST_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """≤ k nearest rows per query_id and key with their rank (``cand_rank``), cut
    at the request's min_similarity; from ``UNLIMITED`` on, all rows inside the cut.

    ``requests``: query_id, _key, limit, min_similarity, _qv (and _doms for the
    domain filter); ``corpus``: doc_id, _key, embedding and columns to carry
    along.  Both sides' vectors have ``dim`` components.  With a column ``_sigs``
    (array of int) on both sides only pairs that share one of its places meet,
    and the k rows are those of each request row.

    Both sides are read twice, for the sizes of keys and for the join: give
    tables that are cheap to read (stored ones, or ``session.written``)."""
    signed = "_sigs" in corpus.columns
    types = {f.name: f.dataType for f in requests.schema.fields} | {f.name: f.dataType for f in corpus.schema.fields}
    carry = [c for c in corpus.columns if c not in ("_key", "embedding", "_sigs")]
    out = T.StructType([T.StructField("query_id", types["query_id"]), T.StructField("limit", types["limit"]),
                        T.StructField("min_similarity", T.DoubleType()), T.StructField("distance", T.DoubleType()),
                        *[T.StructField(c, types[c]) for c in carry], T.StructField("cand_rank", T.IntegerType())])
    vector = types["embedding"] if types["embedding"] == types["_qv"] else T.ArrayType(T.DoubleType())
    requests, corpus = requests.filter(F.col("_key").isNotNull()), corpus.filter(F.col("_key").isNotNull())
    block = max(1, min(request_block, HELD_ROWS // k)) if k < UNLIMITED else request_block
    asked, dealt, tasks = deal(requests, corpus, block)
    extra = (["_doms"] if domain_filter else []) + (["_sigs"] if signed else [])
    asked = asked.select("_task", "_cell", "_side", F.col("_qv").cast(vector).alias("_v"), "query_id", "limit",
                         F.col("min_similarity").cast("double").alias("min_similarity"), *extra)
    dealt = dealt.select("_task", "_cell", "_side", F.col("embedding").cast(vector).alias("_v"), *carry, *(["_sigs"] if signed else []))
    tests = ([_Domains()] if domain_filter else []) + ([_Signatures()] if signed else [])
    rows = asked.unionByName(dealt, allowMissingColumns=True)
    return (rows.repartitionById(tasks, "_task").drop("_task").sortWithinPartitions("_cell", "_side")
            .mapInArrow(_Kernel(dim, metric, k, tests, out, corpus_block), out))
