"""Compare every query with its SQL: ``python tests/parity.py [directory] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def cell(x):
    """A value with its kind, so that 1 and 1.0 differ."""
    if x is None:
        return x
    if isinstance(x, float):
        return ("float", "nan" if math.isnan(x) else round(x, 9))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return (type(x).__name__, x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(cell(r[i]) for i in order) for r in rows), key=repr
    )


def expected(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def actual(df):
    return table(df.columns, df.collect())


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from drillsight.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = oracle_sql()
    bad = []
    for name, f in queries().items():
        if names and name not in names or name not in sql:
            continue
        start = time.time()
        try:
            got = actual(f(spark, folder))
            mid = time.time()
            want = expected(con, sql[name])
            same = got == want
            print(f"{'ok ' if same else 'BAD'} {name:28} rows={len(got[1])} spark={mid - start:.2f}s sql={time.time() - mid:.2f}s", flush=True)
            if not same:
                bad.append(name)
                if got[0] != want[0]:
                    print("  columns", got[0], want[0])
                print("  rows", len(got[1]), len(want[1]))
                for a, b in zip(got[1], want[1]):
                    if a != b:
                        print("  spark", str(a)[:600])
                        print("  sql  ", str(b)[:600])
                        break
        except Exception as e:  # report and go on to the next query
            bad.append(name)
            print(f"ERR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
