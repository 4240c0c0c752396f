"""Runs registered queries and their SQL side by side; usable as a script:
`python tests/oracle_compare.py SF_DIR [name-prefix ...]`."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from idlens.catalog.inputs import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}" if abs(v) < 1e6 else f"{float(v):.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sf_dir):
    df = query.run(spark, sf_dir)
    got_cols, got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return None, len(got), ""
    res = con.execute(query.sql)
    cols = [d[0] for d in res.description]
    want_cols, want = normal_rows(cols, res.fetchall())
    if got_cols != want_cols:
        return False, len(got), f"columns {got_cols} != {want_cols}"
    if got == want:
        return True, len(got), ""
    a, b = set(got) - set(want), set(want) - set(got)
    return False, len(got), f"{len(got)} vs {len(want)} rows; only spark {sorted(a)[:2]}; only sql {sorted(b)[:2]}"


def main():
    from __spark_entry__ import REGISTRY
    from idlens.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, query in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            ok, n, note = compare(spark, con, query, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, n, note = False, -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print(f"{name:32s} {'--' if ok is None else 'ok' if ok else 'BAD'} rows={n} {time.time() - t:.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
