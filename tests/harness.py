"""Run registered queries on Spark and their comparison SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def kind(t: str) -> str:
    t = t.lower()
    for k, names in {"f": ("double", "float", "decimal"), "i": ("bigint", "int", "smallint", "tinyint", "hugeint", "long"),
                     "s": ("string", "varchar"), "d": ("date",), "b": ("boolean",), "t": ("timestamp",)}.items():
        if any(t.startswith(n) for n in names) and not t.endswith("[]"):
            return "t" if t.startswith("timestamp") else k
    return "a"


def compare(spark, con, q, sf_dir: str) -> str:
    t0 = time.time()
    df = q.fn(spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in names) for r in df.collect()]
    t1 = time.time()
    if q.sql is None:
        return f"rows-only {len(rows)} [{t1 - t0:.1f}s]" if rows else "EMPTY"
    rel = con.sql(q.sql)
    cols = list(rel.columns)
    if sorted(cols) != names:
        return f"COLUMNS spark={names} sql={sorted(cols)}"
    kinds = {c: (kind(t), kind(dict(df.dtypes)[c])) for c, t in zip(cols, map(str, rel.types))}
    bad = {c: (k, dict(df.dtypes)[c], str(rel.types[cols.index(c)])) for c, k in kinds.items() if k[0] != k[1]}
    pos = [cols.index(c) for c in names]
    want = [tuple(norm(r[p]) for p in pos) for r in rel.fetchall()]
    t2 = time.time()
    if bad:
        return f"TYPES {bad}"
    if not rows:
        return "EMPTY"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(want, key=key)
    if len(a) != len(b):
        return f"COUNT spark={len(a)} sql={len(b)}\n   {a[:2]}\n   {b[:2]}"

    def close(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return abs(x - y) <= 2e-5 * max(1.0, abs(x))
        if isinstance(x, tuple) and isinstance(y, tuple):
            return len(x) == len(y) and all(map(close, x, y))
        return x == y

    diff = [(x, y) for x, y in zip(a, b) if x != y and not all(map(close, x, y))]
    loose = sum(x != y for x, y in zip(a, b)) - len(diff)
    if diff:
        return f"DIFF {len(diff)}/{len(a)} {names}\n   {diff[0][0]}\n   {diff[0][1]}"
    cols = sorted({n for x, y in zip(a, b) if x != y for n, u, v in zip(names, x, y) if u != v})
    return f"ok {len(a)} rows{f' ({loose} loose {cols})' if loose else ''} [{t1 - t0:.1f}s / {t2 - t1:.1f}s]"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from quantloom.plans.catalog import all_queries
    from quantloom.session import local_session

    sf = sys.argv[1]
    spark, con, qs = local_session(8), connect(sf), all_queries()
    pick = [n for n in qs if any(p in n or p == "@" + qs[n].module or p in qs[n].ids for p in sys.argv[2:])] if sys.argv[2:] else list(qs)
    failed = 0
    for n in pick:
        try:
            res = compare(spark, con, qs[n], sf)
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += not (res.startswith("ok") or res.startswith("rows-only"))
        print(f"{n}: {res}", flush=True)
    print("total", len(pick), "failed", failed)
