"""Run registered queries next to their oracle SQL: python tests/oracle_check.py SF [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    out = {}
    for column in sorted(df.columns):
        values = df[column]
        if pd.api.types.is_datetime64_any_dtype(values):
            out[column] = values.dt.strftime("%Y-%m-%d %H:%M:%S.%f").fillna("NULL")
        else:
            out[column] = [_text(v) for v in values]
    frame = pd.DataFrame(out, dtype=object)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def _text(value) -> str:
    if value is None or (not isinstance(value, (list, tuple, dict)) and pd.isna(value) is True):
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if number != number:
        return "NULL"
    return repr(number) if not isinstance(value, str) else value


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} vs {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} vs {len(expected)}"
    a, b = normal(actual), normal(expected)
    wrong = [c for c in a.columns if not a[c].equals(b[c])]
    if not wrong:
        return None
    at = next(i for i in range(len(a)) if list(a.loc[i]) != list(b.loc[i]))
    return f"{wrong} first at row {at}:\n  spark  {a.loc[at].to_dict()}\n  oracle {b.loc[at].to_dict()}"


def main() -> None:
    import __spark_entry__ as e

    from patronlens.session import get_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = duck(folder), e.oracle_sql()
    names = sys.argv[2:] or list(e.queries())
    bad = 0
    for name in names:
        start = time.time()
        actual = e.queries()[name](spark, folder).toPandas()
        took = time.time() - start
        if name in oracles:
            start = time.time()
            expected = con.execute(oracles[name]).df()
            verdict = difference(actual, expected)
            bad += verdict is not None
            print(f"{name:32} rows={len(actual):7} spark={took:6.2f}s duck={time.time() - start:6.2f}s {'OK' if verdict is None else 'DIFF ' + verdict}", flush=True)
        else:
            print(f"{name:32} rows={len(actual):7} spark={took:6.2f}s (no oracle)", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
