"""Run registered queries and their SQL side by side: `python tests/compare.py [sf_dir] [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def difference(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """What differs between the two sides, or None."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    kinds = {n: (_KINDS.get(t, t), theirs[n]) for n, t in df.dtypes if _KINDS.get(t, t) != theirs[n]}
    mine = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    other = Counter(tuple(_value(r[i]) for i in order) for r in rel.fetchall())
    if mine != other:
        return (
            f"{sum(mine.values())} rows against {sum(other.values())}; only here {list((mine - other).items())[:3]}; "
            f"only there {list((other - mine).items())[:3]}"
        )
    if kinds:
        return f"types {kinds}"
    return None if mine else "no rows"


def main() -> None:
    sys.path.insert(0, ROOT)
    from sitegraph.plans.queries import ORACLES, QUERIES
    from sitegraph.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                found = difference(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                found = f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            found = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += found is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if found is None else found}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
