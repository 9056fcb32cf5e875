"""Run catalog queries beside their SQL twins and compare all values.

    python tests/compare.py --sf /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trialspark-compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return str(v)
    if type(v).__name__ == "Decimal":
        return f"decimal:{v}"
    return str(v)


def compare(spark, con, q, sf: str) -> str:
    """Empty text when both sides agree, else what differs."""
    df = q.run(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    if not q.oracle:
        return "" if got else "no rows"
    cur = con.execute(q.oracle)
    ocols = [d[0] for d in cur.description]
    if sorted(ocols) != cols:
        return f"columns differ: spark={cols} sql={sorted(ocols)}"
    idx = [ocols.index(c) for c in cols]
    want = sorted(tuple(canonical(r[i]) for i in idx) for r in cur.fetchall())
    if got == want:
        return "" if got else "both sides empty"
    a, b = set(got) - set(want), set(want) - set(got)
    return f"rows {len(got)} vs {len(want)}; cols {cols}; only spark: {sorted(a)[:3]}; only sql: {sorted(b)[:3]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    from trialspark.catalog import load_all

    spark, con = session(), duck(args.sf)
    bad = 0
    for name, q in load_all().items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, q, args.sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name:34s} {time.time() - t:6.2f}s {'' if q.oracle else '[rows]'} {problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
