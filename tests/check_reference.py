"""Compare every query with its reference SQL:  python tests/check_reference.py <folder> [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder: str):
    import duckdb

    from concordat.plans.driver_tables import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name, query, text):
    frame = query(spark, folder)
    got = as_bag(frame.columns, frame.collect())
    cursor = con.execute(text)
    columns = [d[0] for d in cursor.description]
    want = as_bag(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} <> {sorted(columns)}"
    if got != want:
        extra, lacking = got - want, want - got
        return (f"{sum(got.values())} rows against {sum(want.values())}; {sum(extra.values())} not expected, "
                f"e.g. {list(extra)[:1]}; {sum(lacking.values())} lacking, e.g. {list(lacking)[:1]}")
    return f"ok {sum(got.values())}" if got else "ok 0 (empty)"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from concordat.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(folder), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            outcome = compare(spark, con, folder, name, queries[name], oracle[name])
        except Exception as error:  # report and go on
            outcome = f"FAIL {type(error).__name__} {str(error)[:700]}"
        print(f"{name:28s} {time.time() - start:5.1f}s {outcome}", flush=True)
