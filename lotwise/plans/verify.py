"""Compare a registered Spark query with its DuckDB oracle.

Mirrors the driver's check: row count, column names, and an
order-insensitive hash of the rows with columns sorted by name.  Values are
normalised before hashing (dates and timestamps as ISO text, floats to 9
significant digits) so engine-specific representations do not matter.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

from lotwise.sources.fixtures import DRIVER_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _digest(columns, rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return [columns[i] for i in order], lines


def duckdb_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES + ("region", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def compare(df, sql: str, sf_dir: str) -> dict:
    s_cols, s_rows = spark_rows(df)
    o_cols, o_rows = duckdb_rows(sql, sf_dir)
    s_names, s_lines = _digest(s_cols, s_rows)
    o_names, o_lines = _digest(o_cols, o_rows)
    result = {
        "rows_spark": len(s_rows), "rows_oracle": len(o_rows),
        "rows_match": len(s_rows) == len(o_rows),
        "schema_match": s_names == o_names,
        "hash_match": hashlib.sha256("\n".join(s_lines).encode()).hexdigest()
        == hashlib.sha256("\n".join(o_lines).encode()).hexdigest(),
    }
    if not result["hash_match"] and result["rows_match"] and result["schema_match"]:
        result["close_match"] = _close(s_cols, s_rows, o_cols, o_rows)
    if not result["schema_match"]:
        result["columns_spark"], result["columns_oracle"] = s_names, o_names
    if not result["hash_match"] and result["schema_match"]:
        only_s = sorted(set(s_lines) - set(o_lines))[:3]
        only_o = sorted(set(o_lines) - set(s_lines))[:3]
        result["sample_spark_only"], result["sample_oracle_only"] = only_s, only_o
    return result


def _close(s_cols, s_rows, o_cols, o_rows, rel: float = 1e-9) -> bool:
    """Row multisets equal with floats compared at relative tolerance ``rel``."""
    def keyed(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        out = []
        for r in rows:
            vals = [r[i] if isinstance(r[i], float) else _norm(r[i]) for i in order]
            out.append((tuple(round(v, 3) if isinstance(v, float) else v for v in vals), vals))
        return sorted(out, key=lambda x: repr(x[0]))
    a, b = keyed(s_cols, s_rows), keyed(o_cols, o_rows)
    for (_, x), (_, y) in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                if abs(u - v) > rel * max(1.0, abs(u), abs(v)):
                    return False
            elif u != v:
                return False
    return True
