"""Run registered queries against their SQL in DuckDB and report differences.

    python tools/check_gate.py [--sf 0.01] [--data /root/testdata] [name …]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_columns = df.columns
    got = canonical([tuple(r) for r in df.collect()], got_columns)
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), want_columns)
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} against {sorted(want_columns)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
        lack = [r for r in want if r not in set(got)][:3] if len(got) < 20000 else []
        return f"{len(got)} rows against {len(want)}: only here {extra}; only SQL {lack}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    kinds = {(type(a), type(b)) for g, w in zip(got, want) for a, b in zip(g, w) if type(a) is not type(b)}
    return f"types differ {kinds}" if kinds else None


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--data", default="/root/testdata")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    folder = f"{args.data}/sf{args.sf}"
    from factloom.plans import load
    reg = load()
    spark, con, failed, slow = session(), duck(folder), [], []
    names = [n for n in reg.QUERIES if not args.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in args.names)]
    for name in names:
        t = time.time()
        try:
            df = reg.QUERIES[name](spark, folder)
            if name in reg.ORACLES:
                problem = compare(df, con, reg.ORACLES[name])
                note = "ok"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as exc:  # report and go on to the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        took = time.time() - t
        slow.append((took, name))
        print(f"{name:28s} {took:6.2f}s  {'FAIL ' + problem if problem else note}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    print("slowest:", [(n, round(t, 1)) for t, n in sorted(slow, reverse=True)[:12]])
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
