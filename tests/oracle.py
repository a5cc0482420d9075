"""Run registered queries next to their DuckDB SQL and compare whole results.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TIMES: dict[str, float] = {}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return str(v)


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(con, df, sql):
    names, rows = canon(df.columns, df.collect())
    TIMES["spark"] = time.time()
    rel = con.sql(sql)
    onames, orows = canon(list(rel.columns), rel.fetchall())
    TIMES["duckdb"] = time.time() - TIMES["spark"]
    if names != onames:
        return f"columns {names} vs {onames}", len(rows)
    kinds = dict(df.dtypes)
    if len(rows) != len(orows):
        return f"rows {len(rows)} vs {len(orows)}", len(rows)
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ {names}\n      {bad[0][0]}\n      {bad[0][1]}", len(rows)
    otypes = dict(zip(rel.columns, map(str, rel.types)))
    odd = {n: (kinds[n], otypes[n]) for n in names if not _same_type(kinds[n], otypes[n])}
    return (f"types {odd}" if odd else None), len(rows)


def _same_type(s, d):
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return pairs.get(s, s) == d


def main():
    from metrospan.session import local_session
    import __spark_entry__ as entry
    args = sys.argv[1:]
    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), []
    for name in names:
        t0 = time.time()
        TIMES.clear()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                problem, n = compare(con, df, oracles[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as exc:  # report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:28s} {n:7d} rows spark {TIMES.get('spark', time.time()) - t0:6.2f}s sql {TIMES.get('duckdb', 0):6.2f}s {'O' if name in oracles else 'R'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
