"""Token ids of whole texts, and token counts behind a digest cache.

The word-level tokenizer drops white space and never merges across it, so
the ids of a text are the ids of its white-space-separated pieces, one after
the other.  ``TokenIds`` keeps the ids of pieces seen before (a bounded
number) and gives only new pieces to the library.  Texts that hold the start
of a special token go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tenderlake.llm.common import as_text, map_batches, utf8, worker_cache, written

TOKENIZER = "word_bpe_49k.json"
#: Pieces, and words, whose ids a Python worker keeps (about 200 bytes each).
CACHE_PIECES = 500_000
#: Punctuation that ends pieces; after a letter it is a token run of its own.
TAIL = b".,;:!?|*%&$#"
LIMIT = 2048
#: Longest piece that is kept; longer ones hardly come twice.
LONGEST_KEPT = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a tokenizer file; an existing path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str = TOKENIZER) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(tokenizer_path(name), "rb") as f:
        body = f.read()
    return hashlib.sha256(body + b"tokenizers " + tokenizers.__version__.encode()).hexdigest()[:32]


class TokenIds:
    """Little-endian uint32 ids of texts, as bytes."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(tokenizer_path(name))
        norm = self.tok.normalizer
        # lower-casing and dropped white space: pieces of either case share their ids
        self.by_piece = norm is not None and "Lowercase" in repr(norm) and norm.normalize_str(" A\t\n") in (" a ", "a")
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.plain = None
        state = json.loads(self.tok.to_str())
        suffix = state["model"].get("end_of_word_suffix")
        if self.by_piece and suffix:
            # lower-case words of letters need no normalising and no pattern: one token in
            # the vocabulary's word-end form closes each, so many can be given at once
            self.ends = np.zeros(max(state["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in state["model"]["vocab"].items() if t.endswith(suffix)]] = True
            state |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {
                "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {
                    "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            self.plain = Tokenizer.from_str(json.dumps(state))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces without white space."""
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [self.plain is not None and t.isalpha() and t == t.lower() and is_normalized("NFC", t) for t in texts]
        out: dict[bytes, bytes] = {}
        rest = [i for i, x in enumerate(letters) if not x]
        plain = [i for i, x in enumerate(letters) if x]
        if plain:
            joined = [" ".join([texts[i] for i in plain[j:j + 500]]) for j in range(0, len(plain), 500)]
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(plain):
                body, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
                out.update((words[i], body[a:b]) for i, a, b in zip(plain, cuts, cuts[1:], strict=False))
            else:
                rest += plain
        for j in range(0, len(rest), 20_000):
            part = rest[j:j + 20_000]
            out.update(zip([words[i] for i in part], self._library([texts[i] for i in part]), strict=True))
        return out

    def _new(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces; punctuation after a letter is a part of its own."""
        cut, need = {}, set()
        for p in pieces:
            head = p.rstrip(TAIL)
            if head and len(head) < len(p) and (97 <= head[-1] <= 122 or head.decode("utf-8", "replace").lower()[-1].isalpha()):
                cut[p] = head, p[len(head):]
                need.update(cut[p])
            else:
                need.add(p)
        known = self.words
        fresh = self._words(list(need.difference(known)))
        if len(known) + len(fresh) <= CACHE_PIECES:
            known.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_KEPT)

        def ids(word: bytes) -> bytes:
            return known[word] if word in known else fresh[word]

        return {p: ids(cut[p][0]) + ids(cut[p][1]) if p in cut else ids(p) for p in pieces}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if not self.by_piece or b"<|" in t}
        pieces = [[] if i in special else t.lower().split() for i, t in enumerate(texts)]
        kept = self.pieces
        fresh = self._new(set().union(*pieces).difference(kept)) if pieces else {}
        if len(kept) + len(fresh) <= CACHE_PIECES:
            kept.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_KEPT)
        find = kept.get
        out = [b"".join([find(x) or fresh.get(x, b"") for x in p]) for p in pieces]
        if special:
            whole = sorted(special)
            for i, ids in zip(whole, self._library([texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
                out[i] = ids
        return out


def token_ids(name: str) -> TokenIds:
    """One per Python worker."""
    return worker_cache(f"tokens {name}", lambda: TokenIds(name))


def normalised(text, tokenizer: str = TOKENIZER):
    """Text in the form that is digested: for a tokenizer that drops white
    space, runs of it become one space."""
    if token_ids(tokenizer).by_piece:
        return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return text


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) stored for ``version``, a row a digest; None before the first append."""
    try:
        stored = spark.read.schema("digest binary, n_tokens bigint, version string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    # two jobs may have appended the same digest; their counts are equal
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, *, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = TOKENIZER, limit: int = LIMIT, batches: int = 1) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_tokens, over_limit.

    Digests of the normalised content and of the tokenizer's version are
    joined to the counts stored under ``cache``; only the distinct contents
    that are missing there are encoded, and their counts are appended.  The
    result reads all counts from the cache.  With ``batches`` the documents
    come in that many batches (by their ids), each of which finds what the
    ones before it have appended.

    Defined results: a null text counts as the empty text (0 tokens); null
    ids and rows that repeat give a row each; an empty table gives none.

    Scale: of a group of copies, one row's text is shuffled (the one with the
    least row hash), the group itself is pre-aggregated by digest.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = as_text(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.unhex(F.sha2(normalised(F.col("text"), tokenizer).cast("binary"), 256)).alias("digest"))
    lean = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "token-digests")
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = token_ids(tokenizer).encode(utf8(batch))
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(x) // 4 for x in ids], pa.int64())], ["digest", "n_tokens"])

    def batch_of(df: DataFrame, i: int) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i) if batches > 1 else df

    for i in range(batches):
        # one row of each content: its least id (a null id stands for itself)
        first = batch_of(lean, i).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        stored = read_cache(spark, cache, version)
        if stored is not None:
            first = first.join(stored, "digest", "left_anti")
        a, b = batch_of(keyed, i).alias("a"), first.alias("b")
        misses = a.join(b, (F.col("a.digest") == F.col("b.digest")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
        (map_batches(misses.select("digest", "text"), encode, "digest binary, n_tokens bigint", keeps_cache=True)
         .withColumn("version", F.lit(version)).write.mode("append").parquet(cache))
    # written, so that a hot digest's rows can be split where they are joined
    counts = written(read_cache(spark, cache, version), "token-counts")
    a, b = lean.alias("a"), counts.alias("b")
    return a.join(b, F.col("a.digest") == F.col("b.digest")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
