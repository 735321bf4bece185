"""Information-theoretic sanitisation of personal data, in DataFrame functions.

Base spans: e-mail addresses, IP addresses, card and phone numbers, leftmost
and non-overlapping per kind; matches that fail their kind's test are dropped.
Start and end count code points, end exclusive.  Matches and the gaps between
them come from one pattern (extract, split), and running sums of their lengths
give the places.  The patterns are stated so that Java's matcher neither
recurses on long matches nor starts anew inside a run it has left: separators
that may repeat inside a match are first replaced by one private sign, which
keeps all lengths.

Disclosure.  A base span's normalised value is a protected entity e, a word of
letters anywhere in its document, outside the matches of its kind, a term t of
its context (with ``context`` less than ``CONTEXT``: within so many code points,
up to the next match of the kind).  Over the documents of the corpus, with
counts d: the entity's information is IC(e) = log(N / d(e)); the term tells
PMI(t, e) = log(N d(t, e) / (d(t) d(e))) of it, where d(t, e) are documents
with t in a context of e and d(t) those with t anywhere.  Pairs of at least
``support`` documents whose share PMI / IC reaches ``generalise`` disclose the
entity: the term's places in the contexts of e become spans ``generalise`` (a
class name stands for the word) or, from ``remove`` on, ``remove``.

Scale: entities of fewer documents than ``support`` have no pairs and are left
out before contexts become rows; a document's terms become rows once an entity,
repeats left out, and places are sought only of terms that disclose; d(t) is one
word count with map-side combination; everything else is as large as the matches
and the texts that hold them.  Nothing is
collected, no group is gathered but a document's own spans.

Defined results: a null text counts as empty; null ids and repeated rows give
a row each; copies count as documents of their own; a document without spans
has zeros, the hash of the empty string and an empty list; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import as_text, prepare, written

# fixed values: the kinds of the base spans in their order, and what may be added
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
MIN_CARD, MAX_CARD, MIN_PHONE, MAX_PHONE = 16, 19, 8, 15

#: From this context on the whole document is looked at.
CONTEXT = 1 << 30
SUPPORT = 3
GENERALISE, REMOVE = 0.7, 0.9

#: Stands for a separator inside a match; where a text has it, its neighbour does.
JOIN, OTHER = "\ue000", "\ue001"
WORD = r"[^\x20\x09-\x0D]+"
#: A term in a word: letters, with quotes, brackets and stops around them.
TERM = r"""^(["'(\[]*)(\p{L}{3,})["')\].,;:!?]*$"""


def _joined(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.translate(text, JOIN, OTHER), pattern, JOIN)


def _email(text: Column) -> tuple[Column, Column, str]:
    local = rf"[A-Za-z0-9._%+{JOIN}-]"
    return (F.contains(text, F.lit("@")), _joined(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"),
            rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]++")


def _ip(text: Column) -> tuple[Column, Column, str]:
    return text.rlike(r"[0-9]\.[0-9]"), text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"


def _card(text: Column) -> tuple[Column, Column, str]:
    return text.rlike(r"[0-9][0-9\x20-]{14}"), _joined(text, r"(?<=[0-9])[\x20-](?=[0-9])"), rf"[0-9][0-9{JOIN}]++"


def _phone(text: Column) -> tuple[Column, Column, str]:
    return F.contains(text, F.lit("+")), text, r"\+[0-9][\x20().0-9-]+[0-9]"


RULES = (_email, _ip, _card, _phone)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = _digits(value)
    n = F.length(digits)
    card = F.when(n.between(MIN_CARD, MAX_CARD), _luhn(digits)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).otherwise(n.between(MIN_PHONE, MAX_PHONE))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind == 0, F.lower(F.translate(value, JOIN, "."))).when(kind == 1, value).otherwise(_digits(value)))


def _placed(kind: int, values: Column, gaps: Column, context: int) -> Column:
    """Structs of a document's matches of one kind."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(F.get(gaps, i + 1)).alias("next"), x.alias("value"),
        F.substring(F.get(gaps, i), -context, context).alias("before"), F.substring(F.get(gaps, i + 1), 1, context).alias("after")))


def matches(texts: DataFrame, context: int) -> DataFrame:
    """``texts`` (doc_id, text) with a number ``rid`` and the raw matches of
    all kinds, each with the gap before it and its contexts; where the whole
    document is the context, its text stays if a match is valid."""
    df = texts.select(F.monotonically_increasing_id().alias("rid"), "*")
    found = []
    near = 0 if context >= CONTEXT else context
    for kind, rule in enumerate(RULES):
        may, text, pattern = rule(F.col("text"))
        m, g, t = f"m{kind}", f"g{kind}", f"t{kind}"
        df = df.withColumn(t, F.when(may, text)).withColumn(m, F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0)))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(t), pattern, -1)))
        found.append(_placed(kind, F.col(m), F.col(g), near))
    df = df.select("rid", "doc_id", "text", F.concat(*found).alias("found"))
    holds = F.exists("found", lambda x: _valid(x["kind"], x["value"]))
    return df.select("rid", "doc_id", "found", F.when(holds & F.lit(context >= CONTEXT), F.col("text")).alias("text"))


def base_spans(found: DataFrame) -> DataFrame:
    """A row a valid match: rid, kind, start, end, entity, and its contexts."""
    rows = found.filter(F.size("found") > 0).select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    size = F.length("value")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("gap") + F.coalesce(F.sum(F.col("gap") + size).over(before), F.lit(0))).cast("bigint")
    rows = rows.withColumn("start", start).filter(_valid(F.col("kind"), F.col("value")))
    return rows.select("rid", "kind", "start", (F.col("start") + size).alias("end"), _entity(F.col("kind"), F.col("value")).alias("entity"), "gap", "next", "before", "after")


def _term(word: Column) -> Column:
    return F.lower(F.regexp_extract(word, TERM, 2))


def _context_terms(side: str, origin: Column, length: Column, cut_left: Column, cut_right: Column) -> Column:
    """Terms of a context string as (term, start, end); a word at a cut may be part of one."""
    words, gaps = F.regexp_extract_all(F.col(side), F.lit(WORD), F.lit(0)), F.split(F.col(side), WORD, -1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (total(F.slice(gaps, 1, i + 1)) + total(F.slice(words, 1, i))).alias("at")))
    whole = F.filter(placed, lambda x: x["word"].rlike(TERM) & ~(cut_left & (x["at"] == 0)) & ~(cut_right & (x["at"] + F.length(x["word"]) == length)))
    return F.transform(whole, lambda x: F.struct(
        _term(x["word"]).alias("term"), (origin + x["at"] + F.length(F.regexp_extract(x["word"], TERM, 1))).alias("start"),
        (origin + x["at"] + F.length(F.regexp_extract(x["word"], TERM, 1)) + F.length(F.regexp_extract(x["word"], TERM, 2))).alias("end")))


def _often(spans: DataFrame, support: int) -> DataFrame:
    return spans.groupBy("entity").agg(F.countDistinct("rid").alias("d_e")).filter(F.col("d_e") >= support)


def gaps(found: DataFrame, held: DataFrame) -> DataFrame:
    """A row a document and kind of ``held`` (rid, kind): the text between the
    kind's matches, and the lengths of these."""
    rows = found.select("rid", "found", "text").join(held, "rid")
    sizes = F.transform(F.filter("found", lambda x: x["kind"] == F.col("kind")), lambda x: F.length(x["value"]))
    parts = F.lit(None)
    for kind, rule in enumerate(RULES):
        _, text, pattern = rule(F.col("text"))
        parts = F.when(F.col("kind") == kind, F.split(text, pattern, -1)).otherwise(parts)
    return rows.select("rid", "kind", parts.alias("gaps"), sizes.alias("sizes"))


def document_terms(parts: DataFrame, entities: DataFrame) -> DataFrame:
    """A row a term in a document of an entity (rid, kind, entity, d_e): rid,
    entity, d_e, term; repeats left out."""
    words = F.flatten(F.transform("gaps", lambda g: F.regexp_extract_all(g, F.lit(WORD), F.lit(0))))
    terms = F.array_distinct(F.transform(F.array_distinct(words), _term))
    return (parts.select("rid", "kind", terms.alias("terms")).join(entities, ["rid", "kind"])
            .select("rid", "entity", "d_e", F.explode("terms").alias("term")).filter("term <> ''"))


def term_places(parts: DataFrame, told: DataFrame) -> DataFrame:
    """The places of the terms of ``told`` (rid, kind, term, action): rid, kind
    number of the span, start, end."""
    before = lambda *by: Window.partitionBy("rid", "kind", *by).orderBy("i" if not by else "j").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(told.select("rid", "kind").distinct(), ["rid", "kind"], "left_semi")
    rows = rows.select("rid", "kind", "sizes", F.posexplode("gaps").alias("i", "gap"))
    size = F.length("gap") + F.coalesce(F.get("sizes", F.col("i")), F.lit(0))
    rows = rows.withColumn("size", size).withColumn("at", F.coalesce(F.sum("size").over(before()), F.lit(0)))
    words, spaces = F.regexp_extract_all("gap", F.lit(WORD), F.lit(0)), F.split("gap", WORD, -1)
    rows = rows.select("rid", "kind", "i", "at", words.alias("words"), spaces.alias("spaces"))
    rows = rows.select("rid", "kind", "i", "at", "spaces", F.posexplode("words").alias("j", "word"))
    rows = rows.select("rid", "kind", "i", "at", "j", "word", F.length(F.get("spaces", F.col("j"))).alias("space"))
    past = F.coalesce(F.sum(F.col("space") + F.length("word")).over(before("i")), F.lit(0))
    start = (F.col("at") + past + F.col("space") + F.length(F.regexp_extract("word", TERM, 1))).cast("bigint")
    rows = rows.select("rid", "kind", _term(F.col("word")).alias("term"), start.alias("start"), (start + F.length(F.regexp_extract("word", TERM, 2))).alias("end"))
    return (rows.filter("term <> ''").join(told, ["rid", "kind", "term"]).groupBy("rid", "start", "end").agg(F.max("action").alias("kind"))
            .select("rid", "kind", "start", "end"))


def contexts(spans: DataFrame, support: int, context: int) -> DataFrame:
    """A row a term in the context of an entity of ``support`` documents: rid,
    entity, d_e, term, start, end."""
    near = spans.join(_often(spans, support), "entity")
    left = _context_terms("before", F.col("start") - F.length("before"), F.length("before"), F.col("gap") > context, F.lit(False))
    right = _context_terms("after", F.col("end"), F.length("after"), F.lit(False), F.col("next") > context)
    return near.select("rid", "entity", "d_e", F.explode(F.concat(left, right)).alias("x")).select("rid", "entity", "d_e", "x.*")


def disclosures(texts: DataFrame, near: DataFrame, n_docs: int, *, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Pairs whose term discloses the entity: term, entity, share, action."""
    pairs = near.groupBy("term", "entity").agg(F.countDistinct("rid").alias("d_te"), F.max("d_e").alias("d_e")).filter(F.col("d_te") >= support)
    words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), _term))
    in_docs = texts.select(F.explode(words).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("d_t"))
    n = F.lit(float(n_docs))
    share = F.log(n * F.col("d_te") / (F.col("d_t") * F.col("d_e"))) / F.log(n / F.col("d_e"))
    # log 1 = 0: an entity in every document has nothing to disclose
    told = pairs.filter(F.col("d_e") < n_docs).join(in_docs, "term").select("term", "entity", share.alias("share"))
    return told.filter(F.col("share") >= generalise).withColumn("action", F.when(F.col("share") >= remove, len(KINDS) + 1).otherwise(len(KINDS)))


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, support: int = SUPPORT,
               generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of all documents and (rid, kind number, start, end) of all spans."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    found = written(matches(texts, context), "pii-matches")
    base = written(base_spans(found), "pii-spans")
    shares = {"support": support, "generalise": generalise, "remove": remove}
    if context >= CONTEXT:
        entities = written(base.select("rid", "kind", "entity").distinct().join(_often(base, support), "entity"), "pii-entities")
        parts = written(gaps(found, entities.select("rid", "kind").distinct()), "pii-gaps")
        told = written(disclosures(texts, document_terms(parts, entities), found.count(), **shares), "pii-disclosures")
        wanted = written(told.join(entities, "entity").groupBy("rid", "kind", "term").agg(F.max("action").alias("action")), "pii-wanted")
        return found.select("rid", "doc_id"), base.select("rid", "kind", "start", "end").unionByName(term_places(parts, wanted))
    near = written(contexts(base, support, context), "pii-contexts")
    told = written(disclosures(texts, near, found.count(), **shares), "pii-disclosures")
    added = (near.join(told.select("term", "entity", "action"), ["term", "entity"]).groupBy("rid", "start", "end").agg(F.max("action").alias("kind"))
             .select("rid", "kind", "start", "end"))
    return found.select("rid", "doc_id"), base.select("rid", "kind", "start", "end").unionByName(added)


def _listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """A row a document with its counts, the digest of its base spans, and all spans."""
    rows, spans = find_spans(docs, **kw)
    per_doc = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < len(KINDS))
    of = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("bigint")
    return (rows.join(per_doc, "rid", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
            .select("doc_id", *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_listed(base, KINDS).cast("binary"), 256).alias("base_sha256"),
                    _listed(F.col("s"), KINDS + ADDED).alias("spans"),
                    *[of(len(KINDS) + k).alias(f"n_{name}") for k, name in enumerate(ADDED)]))


def sanitised_texts(docs: DataFrame, *, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` with their texts sanitised: base spans and
    generalised terms give way to the name of their class, other disclosing
    terms go.  Overlapping spans are joined; the first one names the class.
    A null text stays null."""
    held = written(docs.select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row")), "pii-documents")
    rows, spans = find_spans(held, id_col="id", **kw)
    marks = F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit("")), F.col("kind"))
    before = Window.partitionBy("rid").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("end").over(before), F.lit(0))
    pieces = spans.withColumn("done", done).select("rid", F.struct(
        "start", "end", F.col("done").alias("from"), F.when(F.col("start") >= F.col("done"), marks).otherwise("").alias("mark")).alias("p"))
    per_doc = (pieces.groupBy("rid").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("p.end").alias("last")).join(rows, "rid")
               .select(F.col("doc_id").alias("id"), "p", "last"))
    signs = F.regexp_extract_all("text", F.lit(r"(?s)."), F.lit(0))
    cut = lambda a, b: F.array_join(F.slice(F.col("signs"), a + 1, F.greatest(b - a, F.lit(0))), "")
    new = F.concat(F.array_join(F.transform("p", lambda x: F.concat(cut(x["from"], x["start"]), x["mark"])), ""), cut(F.col("last"), F.size("signs")))
    changed = F.col("p").isNotNull()
    out = held.join(per_doc, "id", "left").withColumn("signs", F.when(changed, signs))
    return out.select(F.when(changed, F.col("row").withField(text_col, new)).otherwise(F.col("row")).alias("row")).select("row.*")
