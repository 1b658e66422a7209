"""Compare queries with their SQL twins: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cellweave.session import TABLES, local_session  # noqa: E402


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def differences(spark, con, name, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} != {sorted(theirs_columns)}"
    at = [theirs_columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    if ours == theirs:
        return ""
    only = [x for x in ours if x not in set(theirs)][:2], [x for x in theirs if x not in set(ours)][:2]
    return f"rows {len(ours)} / {len(theirs)}; {columns}; ours only {only[0]}; sql only {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = views(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracles:
                what = differences(spark, con, name, queries[name], oracles[name], sf_dir) or "equal"
            else:
                what = f"{queries[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # report and go on
            what = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += what.startswith(("rows", "columns", "ERROR"))
        print(f"{name}: {what} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bool(bad))
