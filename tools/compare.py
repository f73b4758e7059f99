"""Order-free comparison of a Spark result with an oracle result."""

import datetime as dt
import decimal
import math


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def sorted_rows(columns, rows):
    """Rows as sorted tuples of normalised values, columns in name order."""
    index = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(norm(r[i]) for i in index) for r in rows)


def oracle_connection(folder, tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con
