"""Registered queries: a DataFrame builder over the whole tables plus, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark import session
from ledgerlark.sources.adapters import ADAPTERS, cte_chain
from ledgerlark.sources.tables import Tables

_WRITTEN: dict[tuple, str] = {}


def _written_key(t: Tables, label: str) -> tuple:
    return label, t.folder, t.spark.sparkContext.applicationId, session.releases


def is_written(t: Tables, label: str) -> bool:
    return _written_key(t, label) in _WRITTEN


def written_once(t: Tables, label: str, write: Callable[[str], None]) -> str:
    """The folder of a table that queries share, written once for each folder of driver tables, until work folders are released."""
    key = _written_key(t, label)
    if key not in _WRITTEN:
        folder = session.work_dir(t.spark, label)
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(sql: str) -> str:
    """Prefix the derived tables that a statement names as common table expressions."""
    words = set(re.findall(r"[a-z_0-9]+", sql))
    parts = [f"{n} AS ({t.strip()})" for n, t in cte_chain(n for n in ADAPTERS if n in words)]
    body = sql.strip()
    if head := re.match(r"with\s+(recursive\s+)?", body, re.I):
        return head[0] + ",\n".join([*parts, body[head.end() :]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap
