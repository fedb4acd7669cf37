"""Metadata filters: nested JSON conditions as one Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where_column(condition: dict, column: Callable[[str], Column] = F.col) -> Column:
    """``{"lang": "en", "$or": [{"n": {"$gt": 5}}, ...]}``; several keys are joined by and."""
    if not condition:
        return F.lit(True)
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{key} needs a list that is not empty")
            op = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(op, [where_column(v, column) for v in value]))
        elif key.startswith("$"):
            raise ValueError(f"operator {key} is not supported here")
        elif isinstance(value, dict):
            for op, operand in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"operator {op} is not supported")
                parts.append(_COMPARE[op](column(key), operand))
        else:
            parts.append(_COMPARE["$eq"](column(key), value))
    return reduce(lambda a, b: a & b, parts)
