"""Runs a registered query and its SQL twin and compares their rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 8))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def kind(value) -> str:
    if value is None:
        return "null"
    return type(value).__name__


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    cur = con.execute(sql)
    other_names = [d[0] for d in cur.description]
    if sorted(other_names) != names:
        return f"columns {names} vs {sorted(other_names)}"
    order = [other_names.index(n) for n in names]
    theirs_raw = cur.fetchall()
    mine = sorted("|".join(plain(v) for v in r) for r in rows)
    theirs = sorted("|".join(plain(r[i]) for i in order) for r in theirs_raw)
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return (f"{len(mine)} vs {len(theirs)} rows; columns {names}\n  spark: {sorted(a)[:3]}"
                f"\n  sql:   {sorted(b)[:3]}")
    kinds = [{kind(r[i]) for r in rows} - {"null"} for i in range(len(names))]
    for i, n in enumerate(names):
        theirs_k = {kind(r[order[i]]) for r in theirs_raw} - {"null"}
        if kinds[i] != theirs_k:
            return f"types of {n}: {kinds[i]} vs {theirs_k}"
    widths = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
              "TIMESTAMP": "timestamp"}
    declared = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    wrong = [(n, d, declared[n]) for n, d in df.dtypes if widths.get(declared[n]) != d.replace("timestamp_ntz", "timestamp")]
    if wrong:
        return f"declared types differ: {wrong}"
    return None if rows else "both sides are empty"


def main(argv: list[str]) -> None:
    """python tests/twin.py SF [name ...]"""
    sys.path.insert(0, ".")
    from floeframe.plans.catalogue import ORACLES, QUERIES
    from floeframe.session import local_session
    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if argv[1:] and name not in argv[1:]:
            continue
        t0 = time.time()
        try:
            if name in ORACLES:
                problem = compare(fn(spark, sf_dir), con, ORACLES[name])
            else:
                problem = None if fn(spark, sf_dir).collect() else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:22s} {time.time() - t0:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
