"""Compare the registered queries with their SQL in DuckDB.

    python -m tests.oracle [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty text when the rows are equal, else what differs."""
    df = fn(spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != names:
        return f"columns {got_names} / {names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    if got == want:
        return "" if got else "no rows"
    for a, b in zip(got, want):
        if a != b:
            return f"values {a} / {b}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from riffle.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "16g",
                                                   "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                note = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                note = "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as error:  # report and go on with the next query
            note = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
