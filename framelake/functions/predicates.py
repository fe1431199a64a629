"""Document predicates as Boolean columns, so that they reach the scan as pushed filters."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _one(c: Column, op: str, value: Any) -> Column:
    if op in ("$eq", "$ne"):
        same = c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False))
        return same if op == "$eq" else ~same
    if op in ("$in", "$nin"):
        among = _any([_one(c, "$eq", x) for x in value])
        return among if op == "$in" else ~among
    if op == "$not":
        return ~_field(c, value)
    ranges = {"$gt": c > F.lit(value), "$gte": c >= F.lit(value), "$lt": c < F.lit(value), "$lte": c <= F.lit(value)}
    if op not in ranges:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(ranges[op], F.lit(False))


def _field(c: Column, wanted: Any) -> Column:
    if isinstance(wanted, dict):
        return _all([_one(c, op, value) for op, value in wanted.items()])
    return _one(c, "$eq", wanted)


def matches(query: dict[str, Any]) -> Column:
    """Whether a row meets a query of $and, $or, $nor, $not, $gt, $gte, $lt, $lte, $eq, $ne, $in and $nin over dotted paths.

    Null meets no range comparison, and meets $ne and $nin. Never null itself.
    """
    parts = []
    for key, value in query.items():
        if key == "$and":
            parts.append(_all([matches(q) for q in value]))
        elif key == "$or":
            parts.append(_any([matches(q) for q in value]))
        elif key == "$nor":
            parts.append(~_any([matches(q) for q in value]))
        elif key == "$not":
            parts.append(~matches(value))
        else:
            parts.append(_field(F.col(key), value))
    return _all(parts)
