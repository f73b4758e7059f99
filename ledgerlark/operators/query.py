"""Filtered, ordered, paged reads of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.json import json_contains


def predicate(df: DataFrame, column: str, op: str, value) -> Column:
    """One of eq neq gt gte lt lte like ilike is in cs.

    `is` takes None, 'not_null', True or False. `cs` takes a mapping for a JSON column and a
    list for an array column. '*' in a like pattern stands for '%'.
    """
    c = F.col(column)
    if op == "is":
        if value is None or value == "not_null":
            return c.isNull() if value is None else c.isNotNull()
        return c.eqNullSafe(bool(value))
    if op == "cs":
        if isinstance(value, dict):
            return json_contains(c, value)
        out = F.lit(True)
        for item in value:
            out = out & F.array_contains(c, item)
        return out
    if op in ("like", "ilike"):
        return getattr(c, op)(str(value).replace("*", "%"))
    simple = {"eq": c.__eq__, "neq": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__, "in": lambda v: c.isin(*v)}
    if op not in simple:
        raise ValueError(f"unknown operator {op!r}")
    return simple[op](value)


def where(df: DataFrame, conditions: dict[str, tuple[str, object] | list[tuple[str, object]]]) -> DataFrame:
    """Conjunction of conditions per column; plain comparisons are pushed to the scan."""
    for column, tests in conditions.items():
        for op, value in tests if isinstance(tests, list) else [tests]:
            df = df.filter(predicate(df, column, op, value))
    return df


def ordering(order: list[str]) -> list[Column]:
    """`'name'`, `'-created_at'`; NULL is last ascending and first descending."""
    return [F.desc_nulls_first(o[1:]) if o.startswith("-") else F.asc_nulls_last(o) for o in order]


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0, select: list[str] | None = None) -> DataFrame:
    """One page: planned as a top-k, never as a full sort."""
    out = df.orderBy(*ordering(order))
    out = (out.offset(offset) if offset else out).limit(limit)
    return out.select(*select) if select else out


def order_by_json(df: DataFrame, column: str, path: str, descending: bool = False) -> DataFrame:
    """Order by the text at a JSON path (text order, also for numbers)."""
    value = F.get_json_object(column, f"$.{path}")
    return df.orderBy(value.desc_nulls_first() if descending else value.asc_nulls_last())
