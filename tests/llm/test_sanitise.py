import hashlib
import math
import random
import re
import string

import pytest
import regex
from pyspark.sql import functions as F

from tenderlake.llm.sanitise import CONTEXT, sanitise, sanitised_texts

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
TERM = regex.compile(r"""^(["'(\[]*)(\p{L}{3,})["')\].,;:!?]*$""")


def luhn(digits):
    d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in d) % 10 == 0


def plain_base(text):
    """(kind, start, end, value, gap before, gap after) by the patterns as they are given."""
    out = []
    for kind, p in enumerate(PATTERNS):
        found = list(re.finditer(p, text))
        ends = [0, *(m.end() for m in found)]
        starts = [*(m.start() for m in found), len(text)]
        for i, m in enumerate(found):
            v = m.group()
            digits = re.sub("[^0-9]", "", v)
            ok = (True, all(int(x) <= 255 for x in v.split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end(), f"{kind}:{v.lower() if kind == 0 else v if kind == 1 else digits}", text[ends[i]:m.start()], text[m.end():starts[i + 1]]))
    return out


def terms(text):
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        t = TERM.match(m.group())
        if t:
            yield t.group(2).lower(), m.start() + t.start(2), m.start() + t.end(2), m.start(), m.end()


def plain(docs, context=CONTEXT, support=3, generalise=0.7, remove=0.9):
    texts = [t or "" for _, t in docs]
    base = [plain_base(t) for t in texts]
    d_e, near, d_t = {}, [], {}
    for rid, spans in enumerate(base):
        for s in spans:
            d_e.setdefault(s[3], set()).add(rid)
        for t in {x[0] for x in terms(texts[rid])}:
            d_t[t] = d_t.get(t, 0) + 1
    for rid, spans in enumerate(base):
        for _, start, end, entity, left, right in spans:
            if len(d_e[entity]) < support:
                continue
            before, after = left[-context:], right[:context]
            near += [(rid, entity, t, start - len(before) + a, start - len(before) + b) for t, a, b, w, _ in terms(before) if not (len(left) > context and w == 0)]
            near += [(rid, entity, t, end + a, end + b) for t, a, b, _, w in terms(after) if not (len(right) > context and w == len(after))]
    d_te, n, added = {}, len(docs), {}
    for rid, entity, t, *_ in near:
        d_te.setdefault((entity, t), set()).add(rid)
    for rid, entity, t, a, b in near:
        k, e = len(d_te[entity, t]), len(d_e[entity])
        if k >= support and e < n:
            share = math.log(n * k / (d_t[t] * e)) / math.log(n / e)
            if share >= generalise:
                added[rid, a, b] = max(added.get((rid, a, b), 4), 5 if share >= remove else 4)
    out = []
    for rid, (doc, _) in enumerate(docs):
        listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
        own = [s[:3] for s in base[rid]]
        more = [(k, a, b) for (r, a, b), k in added.items() if r == rid]
        out.append((doc, *(sum(s[0] == k for s in own) for k in range(4)), hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + more),
                    *(sum(s[0] == k for s in more) for k in (4, 5))))
    return sorted(out, key=str)


def same(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 1, "k", "s", 2, "f") for d in docs], "doc_id bigint, text string, rid int, kind string, start string, i int, found string")
    got = sanitise(df.repartition(4), **kw)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, **kw)
    return df


CARD = "4539578763621486"
ODD = ["", None, "a@b.c_d@e.f", "a@b.c.d..e@f.g", "x@y", "a@-.-", "a..b@c.d.", "é@a.b ü@a.bé", "a@b.c@d.e@f.g.h", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 255.255.255.255 0001.02.3.000255 1..2.3.4.5",
       f"{CARD} {CARD[:4]} {CARD[4:8]}-{CARD[8:]} x", f"{CARD}0 {CARD}  {CARD}", "4539--578763621486", "+1 (988) 555-2485 +12 +123 ++1234567 8 +1-------- +49.30.123456789012345", "123 ab@c.d @x.y", "😀 +4 4 4 4 4 4 4 4 😀 1.1.1.1 😀 a@b.cd",
       "9" * 30_000, "9 " * 30_000, "1." * 30_000, "a." * 30_000 + "@" + "b." * 20_000 + "c", "+1" + " 2" * 20_000, "a" * 60_000, "x@y.z " * 3000 + "1.2.3.4 " * 3000, "+ " * 9000, "-" * 30_000 + "1" + "-" * 30_000]


def test_base_spans_of_odd_texts(spark):
    same(spark, [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(7, "a@b.c_d@e.f")] * 2)


def test_base_spans_of_random_texts(spark):
    r = random.Random(11)
    signs = ["0", "12", "4539", " ", "-", ".", "@", "a", "B_", "+1", "(", ")", "é", "\n", "255", "%", CARD, "é.", "--"]
    docs = [(i, "".join(r.choice(signs) for _ in range(r.randrange(60)))) for i in range(3000)]
    same(spark, docs, support=10_000)


def person_docs(seed=4, n=300):
    r = random.Random(seed)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(2, 9))) for _ in range(120)]
    docs = []
    for i in range(n):
        w = [r.choice(words).capitalize() if r.random() < 0.1 else r.choice(words) for _ in range(r.randrange(5, 80))]
        if i % 6 == 0:
            w.insert(r.randrange(len(w)), r.choice(["Zanzibarro jane.roe@mail.example.com,", "(Quillfeather) +1 (988) 555-2485 zanzibarro", "10.1.2.3 quillfeather's"]))
        if i % 17 == 0:
            w.insert(r.randrange(len(w)), "zanzibarro")
        docs.append((i, " ".join(w) + r.choice([".", "", " \n"])))
    return docs


def test_terms_that_disclose(spark):
    docs = person_docs() + [(None, None), (5, "")]
    loose = {"context": 20, "support": 2, "generalise": 0.4, "remove": 0.8}
    for kw in ({}, loose):
        same(spark, docs, **kw)
    found = {d: s for d, *_, s, _, _ in plain(docs)}
    assert any("remove" in s for s in found.values()) and any("generalise" in r[6] for r in plain(docs, **loose))
    # a document without personal data has no spans
    assert all(s == "" or re.search("email|ip|phone", s) for s in found.values())


def test_sanitised_texts(spark):
    docs = person_docs()
    df = spark.createDataFrame([(*d, 9, "k") for d in docs] + [(900, None, 1, None), (901, "é plain 😀\ntext", 2, "x"), (None, "😀 a@b.c 1.2.3.4", 3, "y")], "doc_id bigint, text string, rid int, _rid string")
    out = sanitised_texts(df.repartition(3))
    assert out.columns == df.columns and out.count() == df.count()
    new = {r.doc_id: r.text for r in out.collect()}
    assert new[900] is None and new[901] == "é plain 😀\ntext" and new[None] == "😀 [EMAIL] [IP]"
    marks = dict(zip(KINDS, ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""], strict=True))
    for d, *_, spans, _, _ in plain([(r.doc_id, r.text) for r in df.collect()]):
        text, want, at = dict(docs).get(d), [], 0
        for a, b, k in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)):
            want, at = [*want, text[at:a], marks[k]] if text else want, b
        if text is not None:
            assert new[d] == "".join(want) + text[at:]


def test_no_python_on_the_path(spark, sf):
    from tenderlake.llm.queries import op11_pii_sanitisation

    plan = op11_pii_sanitisation(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sanitise(df).collect() == [] and sanitised_texts(df).collect() == []


@pytest.mark.parametrize("n", [1, 2])
def test_an_entity_in_all_documents_discloses_nothing(spark, n):
    same(spark, [(i, "write to jane@x.org today") for i in range(3 * n)])


def test_extra_columns_and_order(spark):
    df = same(spark, [(1, "b a@b.c 1.2.3.4 a@b.c")])
    assert sanitise(df.withColumn("text", F.lit(None).cast("string"))).first().spans == ""


def test_terms_far_from_the_entity_are_looked_at(spark):
    far = " ".join(["plain filler"] * 400)
    texts = [f"zanzibarro {far} bob@y.org then jane@x.org {far} quillfeather."] * 4 + [far] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in sanitise(df).collect():
        places = {texts[r.doc_id][int(a):int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "remove"}
        assert places == ({"zanzibarro", "quillfeather", "then"} if r.doc_id < 4 else set())
