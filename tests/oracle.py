"""Run registered queries and their SQL side by side; compare names, types, rows and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def _kind(dtype: str) -> str:
    d = dtype.lower()
    if d.startswith(("bigint", "int", "smallint", "tinyint", "hugeint", "long")):
        return "int"
    if d.startswith(("double", "float")):
        return "float"
    if d.startswith(("varchar", "string")):
        return "string"
    if d.startswith("timestamp"):
        return "timestamp"
    return d


def compare(spark, con, sf_dir, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: _kind(str(d[1])) for d in cur.description}
    got = cur.fetchall()
    t2 = time.time()
    cols = sorted(df.columns)
    problems = []
    if cols != sorted(names):
        problems.append(f"columns {cols} != {sorted(names)}")
        return problems, len(rows), t1 - t0, t2 - t1
    for name, dtype in df.dtypes:
        if _kind(dtype) != types[name]:
            problems.append(f"type {name}: spark {dtype} duckdb {types[name]}")
    if len(rows) != len(got):
        problems.append(f"rows {len(rows)} != {len(got)}")
    pos = [names.index(c) for c in cols]
    a = sorted(tuple(_canon(r[c]) for c in cols) for r in rows)
    b = sorted(tuple(_canon(r[p]) for p in pos) for r in got)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        problems.append(f"values differ: {len(left)} only spark, {len(right)} only sql")
        for label, side in (("spark", left), ("sql", right)):
            for r in sorted(side)[:2]:
                problems.append(f"  {label}: {[(c, v[:150]) for c, v in zip(cols, r)]}")
    distinct = len(set(a))
    if len(rows) > 1 and distinct == 1:
        problems.append("note: all rows equal")
    return problems, len(rows), t1 - t0, t2 - t1


def main(argv):
    from deskspark.session import local_session
    import __spark_entry__ as entry

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session(os.environ.get("ORACLE_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            if name in oracles:
                problems, n, ts, td = compare(spark, con, sf_dir, fn, oracles[name])
                print(f"{'OK ' if not problems else 'BAD'} {name} rows={n} spark={ts:.2f}s sql={td:.2f}s", flush=True)
                for p in problems:
                    print("     ", p)
                bad += bool(problems)
            else:
                t0 = time.time()
                n = len(fn(spark, sf_dir).collect())
                print(f"ROWS {name} rows={n} spark={time.time() - t0:.2f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR {name}: {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
