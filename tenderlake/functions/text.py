"""Text columns: blank test, words, token estimate, cache key, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake import schemas as S

# Python's str.split()/strip() treat all Unicode whitespace as blank; the
# (?U) flag makes Java's \s do the same.
WS = r"(?U)\s+"


def is_blank(text: Column) -> Column:
    """NULL, empty or whitespace-only (newlines and tabs included)."""
    return text.isNull() | text.rlike(r"^(?U)\s*$")


def words(text: Column) -> Column:
    """Whitespace-separated words (no empty strings)."""
    return F.filter(F.split(text, WS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def token_estimate(text: Column) -> Column:
    """Token estimate without a tokenizer: words x 1.3 (double)."""
    return word_count(text).cast("double") * F.lit(S.TOKENS_PER_WORD)


def normalize_ws(text: Column) -> Column:
    """Collapse whitespace runs to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def cache_key(text: Column, model: Column) -> Column:
    """sha256 hex of whitespace-normalised text + '|' + model."""
    return F.sha2(F.concat(normalize_ws(text), F.lit("|"), model), 256)


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 2)


def token_bucket(word: Column, n_buckets: int = 64) -> Column:
    """Bucket of a word: first 8 hex digits of md5 as an integer, mod n.

    For n dividing 256 that only needs the 7th and 8th hex digit.
    """
    if 256 % n_buckets == 0:
        return F.pmod(F.conv(F.substring(F.md5(word), 7, 2), 16, 10).cast("int"),
                      F.lit(n_buckets))
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"),
                  F.lit(n_buckets)).cast("int")
