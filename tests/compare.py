"""Run registered queries against their SQL in DuckDB: python -m tests.compare SF [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if type(v).__name__ == "Decimal":
        return ("decimal", str(v))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in cols]).collect()
    return cols, Counter(tuple(_value(v) for v in r) for r in rows)


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, Counter(tuple(_value(r[i]) for i in at) for r in rel.fetchall())


def diff(spark, con, sf_dir, fn, sql) -> tuple[str, int]:
    cols, got = spark_rows(fn(spark, sf_dir))
    n = sum(got.values())
    if sql is None:
        return ("rows-only" if n else "EMPTY"), n
    want_cols, want = duck_rows(con, sql)
    if cols != want_cols:
        return f"COLUMNS {cols} != {want_cols}", n
    if got != want:
        a, b = got - want, want - got
        return (f"ROWS spark={n} duck={sum(want.values())}\n   only spark: "
                f"{list(a)[:3]}\n   only duck:  {list(b)[:3]}"), n
    types = {type(x) for r in list(got)[:50] for x in r} , {type(x) for r in list(want)[:50] for x in r}
    return ("ok" if types[0] == types[1] else f"ok TYPES {types}") if n else "ok EMPTY", n


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import make_spark

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = make_spark()
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            verdict, n = diff(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            verdict, n = f"ERROR {type(e).__name__} {str(e)[:1500]}", 0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:34s} {n:8d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
