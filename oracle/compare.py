"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    """Comparable form: floats to 9 significant digits, NaN/inf/NULL tagged."""
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        if math.isinf(v):
            return ("inf", v > 0)
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return norm(v.item())
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    if isinstance(v, int):
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:-9] if s.endswith("T00:00:00") else s
    return v


def compare(spark_cols, spark_rows, duck_cols, duck_rows) -> str | None:
    """``None`` when equal, else a short description of the difference."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: spark {spark_cols} duck {duck_cols}"
    order = sorted(spark_cols)
    si = [list(spark_cols).index(c) for c in order]
    di = [list(duck_cols).index(c) for c in order]
    sc = Counter(tuple(norm(r[i]) for i in si) for r in spark_rows)
    dc = Counter(tuple(norm(r[i]) for i in di) for r in duck_rows)
    if sc == dc:
        return None
    return (f"spark {len(spark_rows)} rows, duck {len(duck_rows)} rows; "
            f"spark-only {list((sc - dc).elements())[:2]} duck-only {list((dc - sc).elements())[:2]}")
