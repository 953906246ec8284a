"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if v != v else float(v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def rows(cols: list[str], data) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(rw[i]) for i in order) for rw in data), key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(x) for x in df.collect()]
    out = {"name": name, "sec": round(time.time() - t0, 2), "rows": len(got)}
    if sql is None:
        out["ok"] = len(df.columns) > 0
        return out
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    out["want"] = len(want)
    if sorted(cols) != sorted(df.columns):
        return {**out, "ok": False, "why": f"columns {df.columns} != {cols}"}
    a, b = rows(df.columns, got), rows(cols, want)
    out["ok"] = a == b
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["why"] = f"{sorted(cols)} {bad}"[:900]
    else:
        kinds = dict(df.dtypes)
        duck_kinds = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
        same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        odd = {c: (k, duck_kinds[c]) for c, k in kinds.items() if same.get(k, duck_kinds[c]) != duck_kinds[c]
               or k == "int"}
        if odd:
            out["types"] = odd
    return out


def main(argv):
    from alloscan.catalog import ORACLES, QUERIES
    from alloscan.session import local_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    pick = argv[1:]
    spark = local_session(8)
    con = duck(sf)
    fails = 0
    for name, fn in QUERIES.items():
        if pick and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in pick):
            continue
        try:
            res = compare(spark, con, sf, name, fn, ORACLES.get(name))
        except Exception as e:  # report and go on with the other queries
            res = {"name": name, "ok": False, "why": f"{type(e).__name__}: {e}"[:1200]}
        fails += not res["ok"]
        mark = "ok  " if res["ok"] else "FAIL"
        print(mark, {k: v for k, v in res.items() if k != "ok"}, flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
