"""Compare every registered query with its SQL twin: python tests/twin_check.py [name…]."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cooked = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cooked, key=repr)


def duck(sf_dir=DATA):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def difference(spark_df, con, sql):
    """None when both sides agree, else a short text."""
    s_names, s_rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    d_names, d_rows = table([c[0] for c in cur.description], cur.fetchall())
    if s_names != d_names:
        return f"columns {s_names} != {d_names}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}"
    for a, b in zip(s_rows, d_rows):
        if a != b:
            return f"first difference in {s_names}: {a} != {b}"
    return None if s_rows else "both sides are empty"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    qs, sqls = e.queries(), e.oracle_sql()
    names = argv or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            d = qs[n](spark, DATA)
            if n in sqls:
                msg = difference(d, con, sqls[n])
            else:
                k = d.count()
                msg = None if k else "no rows"
                msg = msg or None
                print(f"  rows-only {n}: {k}")
        except Exception as ex:  # noqa: BLE001
            msg = f"{type(ex).__name__}: {str(ex)[:700]}"
        if msg:
            bad += 1
            print(f"BAD {n} ({time.time() - t0:.1f}s): {msg}", flush=True)
        elif argv:
            print(f"ok  {n} ({time.time() - t0:.1f}s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
