import hashlib
import itertools
import random
import re
import zlib

import pytest

from tenderlake.llm.conversation_repair import Audits, final, ranked, repair_conversations, solve

STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
MADE = {"0": "u", "s": "u", "u": "a", "a": "u"}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, role, text)] * (k != 0) * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def plain_repair(rows):
    """Whole strings in the table of a plain DP."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = WORD.findall(text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    best = {"0": (0, "", ())}

    def put(table, state, x):
        if state not in table or x[:2] < table[state][:2]:
            table[state] = x

    def with_inserts(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                to = MADE[state]
                put(table, to, (cost + 3, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[to])))

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        with_inserts(best)
        new = {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (state, role[:1]) in STEP:
                put(new, STEP[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            to = MADE[state]
            put(new, to, (cost + 3 + more, audit + "R", (*lines, {"u": "user", "a": "assistant"}[to] + f":{text}")))
        best = new
    with_inserts(best)
    cost, audit, lines = min(best[s] for s in ("0", "a") if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return sorted(((c, *plain_repair(x)) for c, x in by.items()), key=str)


def test_prefixes_compare_like_strings():
    r = random.Random(5)
    for base, mod in ((1_000_003, (1 << 61) - 1), (3, 5)):  # the second collides all the time
        a = Audits(base, mod)
        nodes = [0]
        for _ in range(400):
            nodes.append(a.extend(r.choice(nodes[-20:]), r.choice("DK")))
        for x, y in ((r.choice(nodes), r.choice(nodes)) for _ in range(4000)):
            s, t = a.text(x), a.text(y)
            c = a.compare(x, y)
            assert (c > 0) - (c < 0) == (s > t) - (s < t)
        deep = nodes[-1]
        assert all(a.text(a.lift(deep, d)) == a.text(deep)[:d] for d in range(a.depth[deep] + 1))


def test_least_edits_over_all_strings():
    """Against every string of edits (at most two inserts before a row)."""
    texts = {0: "x.", 1: "", 3: "x"}
    for n in (1, 2, 3):
        for case in itertools.product(itertools.product("suat", (0, 1, 3)), repeat=n):
            if n == 3 and random.Random(str(case)).random() > 0.15:
                continue
            a = Audits()
            ends = solve(list(case), 0, a)
            costs, ranks = [x[0] if x else -1 for x in ends], ranked(ends, a)
            cost, last = final(costs, ranks)
            got = (cost, a.text(ends[last][1]) + "I" * (0, 2, 1, 0)[last])
            want = None
            for parts in itertools.product(*[["", "I", "II"]] * (n + 1)):
                for edits in itertools.product("DKR", repeat=n):
                    state, total, ok = "0", 0, True
                    for i in range(n + 1):
                        for _ in parts[i]:
                            state, total = MADE[state], total + 3
                        if i == n:
                            break
                        initial, fault = case[i]
                        ok &= edits[i] == "D" or fault != 1
                        if edits[i] == "D":
                            total += 4
                        elif edits[i] == "K":
                            ok &= (state, initial) in STEP
                            state, total = STEP.get((state, initial), state), total + 3 * (fault == 3)
                        else:
                            state, total = MADE[state], total + 3 + 3 * (fault == 3)
                    if ok and state in "0a":
                        audit = "".join(p + e for p, e in zip(parts, (*edits, ""), strict=True))
                        want = min(want or (99, ""), (total, audit))
            assert got == want, (case, texts)


EDGE = "conv_id bigint, turn bigint, role string, text string, mid string, at int, fault string, rid int"


@pytest.fixture(scope="module")
def edge_rows():
    r = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "system", "S."), (1, None, "tool", "x"), (2, 5, "", "?"), (2, 9, "user", None),
            (3, 0, "user", " \t\n "), (4, 1, "assistant", "only this!"), (5, 1, "user", "a " * 40_000 + "end."), (5, 2, "assistant", "é日本語😀."), (5, 2, "assistant", "é日本語😀."),
            (5, 2, "user", "another in the same turn?")]
    # one conversation holds a third of all rows; some consist of copies
    rows += [(6, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["One.", "two", "", "Three!", f"{t}."])) for t in range(150)]
    rows += [(7, 3, "user", "the same.")] * 20 + [(8, -t, "assistant", "back.") for t in range(12)]
    rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "No", "Well?"])) for c in range(10, 60) for t in range(r.randrange(1, 9))]
    return rows


@pytest.mark.parametrize("rows_shift,fan_shift", [(10, 8), (2, 2), (0, 1)])
def test_repair_against_plain(spark, edge_rows, rows_shift, fan_shift):
    df = spark.createDataFrame([(*r, "m", 1, "f", 2) for r in edge_rows], EDGE)
    out = repair_conversations(df.repartition(3), rows_shift=rows_shift, fan_shift=fan_shift)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(edge_rows)


def test_whole_table_against_plain(spark, sf):
    from tenderlake.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op13_conversation_repair(spark, sf).collect()), key=str) == plain(rows)


def test_empty(spark, edge_rows):
    assert repair_conversations(spark.createDataFrame([], EDGE)).collect() == []
    dropped = [(c, 0) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(*d, "user", "x", "", 0, "", 0) for d in dropped], EDGE)
    assert sorted(map(tuple, repair_conversations(df).collect())) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in dropped]
