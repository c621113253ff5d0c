"""Runs registered queries beside their SQL: python -m verification.check [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, name, query, oracle, sf_dir):
    """(equal?, message) for one query."""
    start = time.time()
    df = query(spark, sf_dir)
    ours = _sorted(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    start = time.time()
    cursor = con.execute(oracle)
    theirs = _sorted([d[0] for d in cursor.description], cursor.fetchall())
    message = f"rows {len(ours[1])}/{len(theirs[1])} spark {took:.1f}s duckdb {time.time() - start:.1f}s"
    if ours[0] != theirs[0]:
        return False, f"{message} columns {ours[0]} / {theirs[0]}"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if len(ours[1]) != len(theirs[1]) or different:
        return False, f"{message} differing {len(different)} e.g. {[str(d)[:400] for d in different[:2]]}"
    return True, message


def main() -> int:
    from forum_signals.session import local_session
    from verification.oracle import ORACLE
    from verification.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:])
    spark, con = local_session(8), views(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name, query in QUERIES.items():
        if wanted and not name.startswith(wanted):
            continue
        if name not in ORACLE:
            print(f"-- {name} has no SQL, rows {query(spark, sf_dir).count()}", flush=True)
            continue
        try:
            equal, message = compare(spark, con, name, query, ORACLE[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            equal, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += [] if equal else [name]
        print(f"{'ok' if equal else 'NO'} {name} {message}", flush=True)
    print(f"{len(failed)} of {len(QUERIES)} differ: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
