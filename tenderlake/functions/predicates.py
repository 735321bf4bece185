"""Metadata filter specs → Column predicates.

A filter spec is a dict ``{key: value}`` or ``{key: {"$op": value}}``;
several keys are ANDed.  Supported operators: ``$eq $ne $gt $gte $lt $lte
$in $nin $like`` and the combinators ``$and`` / ``$or`` (lists of specs).
Keys name typed corpus columns, so the predicate reaches the parquet scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$like": lambda c, v: c.like(v),
}


def _and(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def _or(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def key_predicate(column: Column, cond: Any) -> Column:
    if isinstance(cond, dict):
        parts = []
        for op, v in cond.items():
            if op not in _OPS:
                raise ValueError(f"unsupported filter operator {op!r}")
            parts.append(_OPS[op](column, v))
        return _and(parts)
    return column == F.lit(cond)


def filter_predicate(spec: dict | None, prefix: str = "") -> Column:
    """AND of the predicates of a filter spec (TRUE for an empty spec).

    A NULL metadata value never matches (SQL three-valued logic, then
    coalesced to FALSE).
    """
    if not spec:
        return F.lit(True)
    parts = []
    for key, cond in spec.items():
        if key == "$and":
            parts.append(_and([filter_predicate(s, prefix) for s in cond]))
        elif key == "$or":
            parts.append(_or([filter_predicate(s, prefix) for s in cond]))
        else:
            parts.append(F.coalesce(key_predicate(F.col(prefix + key), cond), F.lit(False)))
    return _and(parts)


def filter_keys(spec: dict | None) -> set[str]:
    """Top-level keys a user spec constrains (these replace context filters)."""
    return {k for k in (spec or {}) if not k.startswith("$")}
