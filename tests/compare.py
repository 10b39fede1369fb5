"""A registered query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def differences(spark, name: str, query, sql: str, folder: str) -> str:
    """'' if both give the same rows."""
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    want, got = con.sql(sql).df(), query(spark, folder).toPandas()
    columns = sorted(want.columns)
    if columns != sorted(got.columns):
        return f"{name}: columns {columns} and {sorted(got.columns)}"

    def plain(x: pd.DataFrame) -> pd.DataFrame:
        x = x[columns].copy()
        for c in columns:
            # integers stay integers where there are no nulls: long keys differ past 2**53
            if pd.api.types.is_float_dtype(x[c]) and x[c].notna().all() and (x[c] == x[c].round()).all() and (x[c].abs() < 2**53).all():
                x[c] = x[c].astype("int64")
            elif pd.api.types.is_numeric_dtype(x[c]) and not pd.api.types.is_bool_dtype(x[c]):
                x[c] = x[c].astype("int64" if pd.api.types.is_integer_dtype(x[c]) and x[c].notna().all() else float)
        return x.astype(str).sort_values(columns).reset_index(drop=True)

    a, b = plain(want), plain(got)
    if len(a) != len(b):
        return f"{name}: {len(a)} and {len(b)} rows"
    bad = (a != b).any(axis=1)
    return f"{name}: {a[bad].head(2).to_dict('records')} and {b[bad].head(2).to_dict('records')}" if bad.any() else ""
