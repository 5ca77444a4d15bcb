"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, function, sql):
    """Message about the first difference, or None."""
    df = function(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    if not want:
        return f"{name}: no rows to compare"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{name}: {len(got)} rows, expected {len(want)}; only here {a}; only there {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from weftline.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, sf_dir, name, function, oracles[name])
            else:
                message = None if function(spark, sf_dir).count() else f"{name}: no rows"
        except Exception as error:  # noqa: BLE001
            message = f"{name}: {type(error).__name__} {str(error)[:600]}"
        bad += message is not None
        print(f"{'BAD ' if message else 'ok  '} {name} {time.time() - start:.1f}s {(message or '')[:900]}", flush=True)
    print("different:", bad)
