"""Secret scans: fixed patterns, and windows of high Shannon entropy.

Patterns ("base" spans; start and end count code points, end exclusive):
``assign``, ``access`` and ``hex``, leftmost non-overlapping per kind.

Entropy spans: candidate strings are runs of ``[A-Za-z0-9+/_=-]`` of at least
``WINDOW`` characters.  A window of ``WINDOW`` characters slides over each
candidate; character counts change by one character in and one out, and the
entropy follows from a running sum of count * log2(count).  The window's
character class (hex digits, no digit at all, letters and digits, base64
signs) sets the threshold; windows above it, joined where they overlap, are a
span of kind ``entropy_hex``, ``entropy_letters``, ``entropy_alnum`` or
``entropy_base64``.  A window without digits must also hold ``MIN_CASE``
letters of either case.  Allow-listed strings (what looks like words: one case,
or capitalised parts, joined or not; UUIDs, one repeated pattern, hashes named
as integrity sums, numbers) and spans inside a base span are dropped.

Defined results: a null text counts as the empty text; null ids and repeated
rows give a row each; an empty table gives none; other columns are ignored.
A match of any length is found: whole texts are read, in one pass.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import as_text, map_batches

# fixed values: the patterns of the three base kinds, in their order
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits a character that a window must exceed, by class.  Twenty characters
#: drawn from 16 hex digits have about 3.3 bits, from 52 letters or more about 4.0.
THRESHOLDS = {"hex": 2.9, "letters": 3.65, "alnum": 3.6, "base64": 3.7}
MIN_CASE = 4
ALLOWED = (
    re.compile(r"(?:[a-z]+|[A-Z]+)(?:[-_/]+(?:[a-z]+|[A-Z]+))*[-_/=]*"),  # words of one case and paths of them
    re.compile(r"[-_/]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[-_/]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}))*[-_/=]*"),  # capitalised parts
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*"),  # numbers and dates
    re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),  # UUIDs
    re.compile(r"sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"),  # integrity sums
    re.compile(r"(.{1,8}?)\1+.{0,7}", re.S),  # one short pattern again and again
)
HEX_SIGNS = frozenset("0123456789abcdefABCDEF")
BASE64_SIGNS = frozenset("+/_=-")
_LOG = [0.0, 0.0] + [n * math.log2(n) for n in range(2, WINDOW + 1)]

SCHEMA = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then of kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a long run lies inside one white-space-separated piece
    if max(map(len, text.split()), default=0) >= MIN_HEX:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def window_entropies(s: str) -> list[tuple[float, str]]:
    """Entropy and character class of every window, by incremental counts;
    class ``words`` (no digit, hardly two cases) has no threshold."""
    count: dict[str, int] = {}
    total, n_hex, n_base64, out = 0.0, 0, 0, []
    n_digit = n_upper = n_lower = 0
    log_window = math.log2(WINDOW)
    for i, c in enumerate(s):
        k = count.get(c, 0)
        total += _LOG[k + 1] - _LOG[k]
        count[c] = k + 1
        n_hex += c in HEX_SIGNS
        n_base64 += c in BASE64_SIGNS
        n_digit += c.isdigit()
        n_upper += c.isupper()
        n_lower += c.islower()
        if i >= WINDOW:
            old = s[i - WINDOW]
            k = count[old]
            total += _LOG[k - 1] - _LOG[k]
            count[old] = k - 1
            n_hex -= old in HEX_SIGNS
            n_base64 -= old in BASE64_SIGNS
            n_digit -= old.isdigit()
            n_upper -= old.isupper()
            n_lower -= old.islower()
        if i >= WINDOW - 1:
            kind = "hex" if n_hex == WINDOW else "letters" if not n_digit else "base64" if n_base64 else "alnum"
            bits = log_window - total / WINDOW
            out.append((bits, kind if kind != "letters" or min(n_upper, n_lower) >= MIN_CASE else "words"))
    return out


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the runs of windows above their threshold, the
    kind being that of the run's first window."""
    if max(map(len, text.split()), default=0) < WINDOW:
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(a.fullmatch(s) for a in ALLOWED):
            continue
        begin = None
        for i, (bits, kind) in enumerate(window_entropies(s)):
            high = bits > THRESHOLDS.get(kind, math.inf)
            if high and begin is not None and i <= end:
                end = i + WINDOW
            elif high:
                if begin is not None:
                    out.append((m.start() + begin, first, m.start() + end))
                begin, end, first = i, i + WINDOW, f"entropy_{kind}"
        if begin is not None:
            out.append((m.start() + begin, first, m.start() + end))
    if not base or not out:
        return out
    # a span lies in a base span if one that starts no later ends no earlier
    starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    return [x for x in out if not (at := bisect_right(starts, x[0])) or ends[at - 1] < x[2]]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    base = base_spans(text)
    return base, entropy_spans(text, base)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlaps joined, replaced by ``mark``."""
    base, more = scan(text)
    spans = sorted((a, b) for a, _, b in [*base, *more])
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        if a >= at or i == 0:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document with the counts, the digest of the base spans and all spans."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, more = scan(text)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            # by start, then kind as listed: the three base kinds come first
            spans = sorted([(a, k, KINDS[k], b) for a, k, b in base] + [(a, 3, kind, b) for a, kind, b in more])
            rows.append((doc, *n, hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans), len(more)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          [x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text")), run, SCHEMA)


def redact_documents(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns; texts with secrets have them replaced (a
    null text stays null) and their character count renewed."""
    schema = docs.schema
    at, at_chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = [None if t is None else redact(t) for t in old]
        cols = list(batch.columns)
        cols[at] = pa.array(new, cols[at].type)
        if at_chars is not None:
            cols[at_chars] = pa.array([n if a == b else len(b) for n, a, b in zip(cols[at_chars].to_pylist(), old, new, strict=True)],
                                      cols[at_chars].type)
        return pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return map_batches(docs, run, schema, text_col)
