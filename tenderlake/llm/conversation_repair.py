"""Conversation structure repair: cheapest edits by a persistent audit DP.

Rows are damaged by a rule on their key, put in order, marked with their first
fault (blank, duplicate, truncated) and repaired by the cheapest edits that
make the role initials match ``(s?(ua)+)?``.

The DP walks the rows with four states (nothing yet, s, u, a).  An edit prefix
is a node linked to the prefix before it; nodes carry their depth, ancestors
at powers of two and a rolling hash.  Two prefixes of equal cost compare by a
search for their longest common prefix over those ancestors; hashes that agree
are verified letter by letter once (``Audits.same`` remembers what it has
seen), and a collision falls back to the letters.

Scale: rows are sorted by key and cut into segments of ``2 ** rows_shift``
rows; a segment's part of a conversation gives, for every pair of states, its
least cost, its edits, and their rank among the part's edits.  A string of
edits ends with one that uses up a row, so no string of a part is a proper
prefix of another and concatenations compare part by part.  Parts that may go
on in a neighbour segment are merged ``2 ** fan_shift`` at a time (the same DP
over ranks as letters) until each conversation is one; then the choice goes
down again.  No task holds more rows of a conversation than a segment, however
long it is.  Only the SHA-256 of a repaired conversation is sequential by its
definition: one task streams that conversation's lines and holds a batch.

Defined results: a null conv_id is a conversation of its own and stays null
in the result; a null turn sorts first and counts for no gap; a null role or
text is one space (and one space stands for a null key in the damage rule).
Rows of one turn follow by role, then by the MD5 of their text.  The initial
of an empty role is none, so any pair with it is illegal.  An empty table
gives no rows; a conversation without rows after the damage has zeros, an
empty audit and the hash of the empty string; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import prepare, release_cache, written

ROWS_SHIFT = 10
FAN_SHIFT = 8
#: States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or re-roled row.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Inserts that end a conversation well, by state.
CLOSING = (0, 2, 1, 0)
BLANK, DUPLICATE, CUT = 1, 2, 3


class Audits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self, base: int = 1_000_003, mod: int = (1 << 61) - 1):
        self.base, self.mod = base, mod
        self.up: list[list[int]] = [[]]
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.known: set[tuple[int, int]] = set()

    def extend(self, node: int, letter: str) -> int:
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(up)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter) + 1) % self.mod)
        return len(self.up) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def lift(self, node: int, depth: int) -> int:
        steps, k = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal hash and depth are equal strings."""
        seen = []
        while a != b and (a, b) not in self.known:
            if self.letter[a] != self.letter[b]:
                return False
            seen.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        self.known.update(seen)
        return True

    def compare(self, x: int, y: int) -> int:
        if x == y:
            return 0
        depth = min(self.depth[x], self.depth[y])
        a, b = self.lift(x, depth), self.lift(y, depth)
        if self.hash[a] == self.hash[b]:
            if self.same(a, b):
                return self.depth[x] - self.depth[y]
            return self._by_letters(x, y)
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if self.same(self.up[a][0], self.up[b][0]):
            return -1 if self.letter[a] < self.letter[b] else 1
        return self._by_letters(x, y)

    def _by_letters(self, x: int, y: int) -> int:
        a, b = self.text(x), self.text(y)
        return (a > b) - (a < b)


class _Best:
    """The least (cost, edits) offered for each state."""

    def __init__(self, audits: Audits):
        self.audits = audits
        self.at: list[tuple[int, int, str] | None] = [None] * 4

    def offer(self, state: int, cost: int, node: int, letter: str) -> None:
        held = self.at[state]
        if held is None or cost < held[0]:
            self.at[state] = (cost, node, letter)
        elif cost == held[0]:
            a = self.audits
            mine, other = a.extend(node, letter), a.extend(held[1], held[2]) if held[2] else held[1]
            self.at[state] = (cost, mine, "") if a.compare(mine, other) < 0 else (cost, other, "")

    def nodes(self) -> list[tuple[int, int] | None]:
        return [x and (x[0], self.audits.extend(x[1], x[2]) if x[2] else x[1]) for x in self.at]


def _inserted(held: list[tuple[int, int] | None], audits: Audits) -> list[tuple[int, int] | None]:
    """With the rows that may be inserted before the next row."""
    best = _Best(audits)
    best.at = [x and (*x, "") for x in held]
    for state in (START, SYSTEM, ASSISTANT):
        if held[state]:
            best.offer(USER, held[state][0] + INSERT, held[state][1], "I")
    held = best.nodes()
    best.at = [x and (*x, "") for x in held]
    if held[USER]:
        best.offer(ASSISTANT, held[USER][0] + INSERT, held[USER][1], "I")
    return best.nodes()


def solve(rows: list[tuple[str, int]], start: int, audits: Audits) -> list[tuple[int, int] | None]:
    """Least (cost, edits) from a state to every state over (initial, fault) rows."""
    held: list[tuple[int, int] | None] = [None] * 4
    held[start] = (0, 0)
    for initial, fault in rows:
        best = _Best(audits)
        for state, x in enumerate(_inserted(held, audits)):
            if x is None:
                continue
            cost, node = x
            best.offer(state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED if fault == CUT else 0
            to = NEXT.get((state, initial))
            if to is not None:
                best.offer(to, cost + more, node, "K")
            best.offer(MADE[state], cost + REROLE + more, node, "R")
        held = best.nodes()
    return held


def ranked(entries: list[tuple[int, int] | None], audits: Audits) -> list[int]:
    """Ranks of the entries' strings among each other (equal strings share one)."""
    order = sorted({x[1] for x in entries if x}, key=functools.cmp_to_key(audits.compare))
    rank, at = {}, -1
    for i, node in enumerate(order):
        at += i == 0 or audits.compare(order[i - 1], node) != 0
        rank[node] = at
    return [rank[x[1]] if x else 0 for x in entries]


def final(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """(cost, last state) of the best whole repair; ``costs`` by last state, -1: none."""
    return min((costs[s] + INSERT * CLOSING[s], ranks[s], s) for s in range(4) if costs[s] >= 0)[::2]


def edited(audit: str, initials: list[str], start: int) -> tuple[list[tuple[list[str], str | None]], list[str]]:
    """For every row the rows inserted before it and its role (None: as it is;
    "": deleted), and the rows inserted after the last."""
    out, new, state, at = [], [], start, 0
    for c in audit:
        if c == "I":
            state = MADE[state]
            new.append(f"{ROLE[state]}:")
            continue
        if c == "D":
            out.append((new, ""))
        elif c == "K":
            state = NEXT[state, initials[at]]
            out.append((new, None))
        else:
            state = MADE[state]
            out.append((new, ROLE[state]))
        new, at = [], at + 1
    return out, new


STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
PART = f"conv_id bigint, at bigint, open boolean, {STATS}, costs array<bigint>, ranks array<int>, audits array<string>, mids array<bigint>, initials array<string>"
NODE = f"conv_id bigint, at bigint, {STATS}, costs array<bigint>, ranks array<int>, paths array<string>"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
LEGAL = frozenset(("su", "ua", "au"))
_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, _TYPES[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _stats(initials: list[str], faults: list[int], turns: list[int | None]) -> tuple:
    known = [t for t in turns if t is not None]
    return (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            initials[0], initials[-1], known[0] if known else None, known[-1] if known else None, len(set(known)))


def _joined(a: tuple, b: tuple) -> tuple:
    """Stats of two neighbour parts as one."""
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3] + (a[5] + b[4] not in LEGAL), a[4], b[5], b[6] if a[6] is None else a[6],
            a[7] if b[7] is None else b[7], a[8] + b[8] - (a[7] is not None and a[7] == b[6]))


def _parts(t: pa.Table) -> pa.Table:
    """The conversations' parts in one segment."""
    release_cache()
    t = t.sort_by("rid")
    conv, mid, turn, initial, fault = (t.column(c).to_pylist() for c in ("conv_id", "mid", "turn", "initial", "fault"))
    seg, out, at = t.column("at")[0].as_py(), [], 0
    for to in range(1, len(conv) + 1):
        if to < len(conv) and conv[to] == conv[at]:
            continue
        a, rows = Audits(), list(zip(initial[at:to], fault[at:to], strict=True))
        opened = at == 0 or to == len(conv)
        ends = [x for s in (range(4) if opened else (START,)) for x in solve(rows, s, a)]
        costs, ranks = [x[0] if x else -1 for x in ends], ranked(ends, a)
        if opened:
            audits = [a.text(x[1]) if x else "" for x in ends]
        else:
            cost, last = final(costs, ranks)
            audits, costs = [a.text(ends[last][1]) + "I" * CLOSING[last]], [cost]
        out.append((conv[at], seg, opened, *_stats(initial[at:to], fault[at:to], turn[at:to]), costs, ranks, audits, mid[at:to], initial[at:to]))
        at = to
    return _table(out, PART)


def _merge(t: pa.Table) -> pa.Table:
    """Neighbour parts of one conversation as one; ``paths`` lists the state
    before each part and after the last."""
    release_cache()
    rows = t.sort_by("at").to_pylist()
    stats = functools.reduce(_joined, (tuple(r[c] for c in STAT_NAMES) for r in rows))
    a, ends, ways = Audits(), [], []
    for start in range(4):
        held: list[tuple[int, int] | None] = [None] * 4
        held[start] = (0, 0)
        back: list[list[int]] = []
        for r in rows:
            wins: list[tuple[int, int, int] | None] = [None] * 4
            for s, e in ((s, e) for s in range(4) for e in range(4) if held[s] and r["costs"][4 * s + e] >= 0):
                cost, node = held[s][0] + r["costs"][4 * s + e], a.extend(held[s][1], chr(r["ranks"][4 * s + e]))
                if wins[e] is None or cost < wins[e][0] or (cost == wins[e][0] and a.compare(node, wins[e][1]) < 0):
                    wins[e] = (cost, node, s)
            held = [w and w[:2] for w in wins]
            back.append([w[2] if w else -1 for w in wins])
        for e in range(4):
            ends.append(held[e])
            way, s = [e], e
            for came in reversed(back):
                s = came[s] if s >= 0 else -1
                way.append(s)
            ways.append("".join(map(str, reversed(way))) if held[e] else "")
    out = (rows[0]["conv_id"], rows[0]["up"], *stats, [x[0] if x else -1 for x in ends], ranked(ends, a), ways)
    return _table([out], NODE)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage (nulls: one space): conv_id, turn, role, text."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"),
                        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
                        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
            .filter("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("kind", "copy"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in order with their number ``rid`` (dense), written once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(in_order.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mono")), "conversation-order")
    # a row a range partition
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "pid").withColumn("rid", F.col("offset") + F.col("mono") - F.shiftleft(F.col("pid").cast("bigint"), 33)).drop("pid", "mono", "offset")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(conversations: DataFrame, *, rows_shift: int = ROWS_SHIFT, fan_shift: int = FAN_SHIFT) -> tuple[DataFrame, DataFrame]:
    """(a row a conversation, the repaired rows in order).

    The first: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit.  The second: conv_id, rid (order), line (``role:text``, with the
    lines inserted before it)."""
    prepare(conversations.sparkSession)
    # the number of a row must not change once it is given: written
    source = written(damaged(conversations).withColumn("mid", F.monotonically_increasing_id()), "conversation-rows")
    white = r"\x20\x09-\x0D"
    narrow = source.select("mid", "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
                           (~F.col("text").rlike(f"[^{white}]")).alias("is_blank"), (~F.col("text").rlike(rf"[.!?][{white}]*\z")).alias("is_cut"))
    rows = written(_numbered(narrow, ["conv_id", "turn", "role", "digest", "mid"]), "conversation-numbered")
    firsts = rows.filter("not is_blank").groupBy("conv_id", "role", "digest").agg(F.min("rid").alias("first")).select("first")
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("is_cut"), CUT).otherwise(0)
    flagged = rows.join(firsts, F.col("rid") == F.col("first"), "left").select(
        F.shiftright("rid", rows_shift).alias("at"), "rid", "conv_id", "mid", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    parts = written(flagged.groupBy("at").applyInArrow(_parts, PART), "conversation-parts")

    # parts at the borders of segments: merged until a conversation is one
    nodes = parts.filter("open").select("conv_id", "at", *STAT_NAMES, "costs", "ranks")
    levels: list[DataFrame] = []
    while True:
        level = nodes.withColumn("up", F.shiftright("at", fan_shift))
        merged = written(level.groupBy("conv_id", "up").applyInArrow(_merge, NODE), "conversation-level")
        levels.append(merged)
        if not merged.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
            break
        nodes = merged.drop("paths")

    def best(t):  # a row a conversation: the last state of its best repair
        for batch in t:
            got = [final(c[:4], r[:4]) for c, r in zip(batch.column("costs").to_pylist(), batch.column("ranks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)] + list(batch.columns), ["cost", "to", *batch.schema.names])

    root = written(levels[-1].mapInArrow(best, f"cost bigint, to bigint, {NODE}"), "conversation-root")
    chosen = root.select("conv_id", "at", F.lit(0).cast("bigint").alias("s0"), F.col("to").alias("s1"))
    for i in reversed(range(len(levels))):
        below = levels[i - 1] if i else parts.filter("open")
        picked = chosen.alias("a").join(levels[i].alias("b"), _same(F.col("a.conv_id"), F.col("b.conv_id")) & (F.col("a.at") == F.col("b.at"))).select(
            "a.conv_id", "a.at", F.expr("b.paths[cast(a.s0 * 4 + a.s1 as int)]").alias("path"))
        # the parts below, in order, take the states along the path
        steps = picked.select("conv_id", "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("path") - 1), lambda k: F.substring("path", k, F.lit(2)))).alias("i", "step"))
        place = Window.partitionBy("conv_id", "up").orderBy("at")
        children = below.select("conv_id", "at", F.shiftright("at", fan_shift).alias("up")).withColumn("i", F.row_number().over(place) - 1)
        chosen = steps.alias("a").join(children.alias("b"), _same(F.col("a.conv_id"), F.col("b.conv_id")) & (F.col("a.at") == F.col("b.up")) & (F.col("a.i") == F.col("b.i"))).select(
            "b.conv_id", "b.at", F.substring("step", 1, 1).cast("bigint").alias("s0"), F.substring("step", 2, 1).cast("bigint").alias("s1"))
    closing = F.element_at(F.array(*[F.lit("I" * n) for n in CLOSING]), F.col("to").cast("int") + 1)
    pieces = written(
        parts.filter("open").alias("p").join(chosen.alias("c"), _same(F.col("p.conv_id"), F.col("c.conv_id")) & (F.col("p.at") == F.col("c.at"))).select(
            "p.conv_id", "p.at", "c.s0", F.expr("p.audits[cast(c.s0 * 4 + c.s1 as int)]").alias("audit"), "mids", "initials")
        .unionByName(parts.filter("not open").select("conv_id", "at", F.lit(0).cast("bigint").alias("s0"), F.col("audits")[0].alias("audit"), "mids", "initials")),
        "conversation-pieces")

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    opened = root.select("conv_id", gaps, *counts, "cost", closing.alias("end"))
    closed = parts.filter("not open").select("conv_id", gaps, *counts, F.col("costs")[0].alias("cost"), F.lit("").alias("end"))
    audits = pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    found = opened.unionByName(closed).alias("a").join(audits.alias("b"), _same(F.col("a.conv_id"), F.col("b.conv_id"))).select(
        "a.conv_id", "gaps", *counts, "cost", F.concat("b.audit", "a.end").alias("audit"))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero = F.lit(0).cast("bigint")
    result = every.alias("e").join(found.alias("f"), _same(F.col("e.conv_id"), F.col("f.conv_id")), "left").select(
        "e.conv_id", *[F.coalesce(F.col(f"f.{c}"), zero).alias(c) for c in ("gaps", *counts, "cost")], F.coalesce("f.audit", F.lit("")).alias("audit"))

    def plan(batches):
        names = ["conv_id", "at", "i", "mid", "new", "role"]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                edits, last = edited(r["audit"], r["initials"], r["s0"])
                out += [(r["conv_id"], r["at"], i, mid, new, role) for i, ((new, role), mid) in enumerate(zip(edits, r["mids"], strict=True)) if new or role != ""]
                if last:
                    out.append((r["conv_id"], r["at"], len(edits), None, last, ""))
            yield from _table(out, "conv_id bigint, at bigint, i bigint, mid bigint, new array<string>, role string").select(names).to_batches()

    edits = pieces.mapInArrow(plan, "conv_id bigint, at bigint, i bigint, mid bigint, new array<string>, role string")
    own = F.when(F.coalesce(F.col("e.role"), F.lit("-")) != "", F.concat(F.coalesce("e.role", "s.role"), F.lit(":"), F.col("s.text")))
    lines = edits.alias("e").join(source.alias("s"), F.col("e.mid") == F.col("s.mid"), "left").select("e.conv_id", "e.at", "e.i", F.concat_ws("\n", "e.new", own).alias("line"))
    # the inserted rows that close a conversation over several parts stand after its last part
    after = F.transform(F.sequence(F.lit(1), F.length("end")), lambda k: F.when(F.col("to") == SYSTEM, F.element_at(F.array(F.lit("user:"), F.lit("assistant:")), k)).otherwise(F.lit("assistant:")))
    tail = root.withColumn("end", closing).filter("length(end) > 0").select("conv_id", F.lit((1 << 62)).alias("at"), F.lit(0).cast("bigint").alias("i"), F.array_join(after, "\n").alias("line"))
    return result, lines.unionByName(tail)


def hashed(lines: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its lines in order, newline-joined; a task
    streams a conversation's lines, holding one batch."""
    def run(batches):
        release_cache()
        none = object()
        held, sha = none, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist(), strict=True):
                if held is not none and conv == held:
                    sha.update(b"\n")
                else:
                    if held is not none:
                        done.append((held, sha.hexdigest()))
                    held, sha = conv, hashlib.sha256()
                sha.update(line)
            yield from _table(done, "conv_id bigint, repaired_sha256 string").to_batches()
        if held is not none:
            yield from _table([(held, sha.hexdigest())], "conv_id bigint, repaired_sha256 string").to_batches()

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at", "i").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, *, rows_shift: int = ROWS_SHIFT, fan_shift: int = FAN_SHIFT) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    found, lines = repair(conversations, rows_shift=rows_shift, fan_shift=fan_shift)
    empty = hashlib.sha256(b"").hexdigest()
    return found.alias("a").join(hashed(lines).alias("b"), _same(F.col("a.conv_id"), F.col("b.conv_id")), "left").select(
        "a.*", F.coalesce("b.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
