"""Metadata filters given as nested dicts, turned into one column expression."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(filters: dict | None) -> Column:
    """``{"year": {"$gte": 2020}}``, ``{"$and": [...]}`` and so on; several keys mean all.

    A row without the field passes only the negative tests, as it holds no such value.
    """
    if not filters:
        return F.lit(True)
    parts = []
    for key, test in filters.items():
        if key == "$and":
            parts.append(reduce(and_, [where(f) for f in test]))
        elif key == "$or":
            parts.append(reduce(or_, [where(f) for f in test]))
        elif isinstance(test, dict):
            for op, value in test.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                passes_absent = op in ("$ne", "$nin")
                parts.append(F.coalesce(_COMPARE[op](F.col(key), value), F.lit(passes_absent)))
        else:
            parts.append(F.coalesce(F.col(key) == test, F.lit(False)))
    return reduce(and_, parts)
