"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Comparison is order-insensitive: columns sorted by name, rows sorted, values
normalised (floats rounded to 6 decimals, NaN/None as None).

    python -m tenderlake.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import json
import math
import sys
import time

import duckdb

from tenderlake.sources.tables import TABLE_NAMES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


_SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
                  "int": "INTEGER"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from tenderlake.plans.registry import ORACLE, QUERIES
    res = {"name": name}
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rec = [tuple(r) for r in sdf.collect()]
    res["spark_sec"] = round(time.time() - t0, 2)
    res["spark_rows"] = len(s_rec)
    if name not in ORACLE:
        res["status"] = "no-oracle"
        return res
    t1 = time.time()
    rel = con.sql(ORACLE[name])
    d_cols = list(rel.columns)
    d_rec = rel.fetchall()
    res["duck_sec"] = round(time.time() - t1, 2)
    res["duck_rows"] = len(d_rec)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = "schema"
        res["detail"] = {"spark": s_cols, "duck": d_cols}
        return res
    spark_types = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    duck_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    if spark_types != duck_types:
        res["status"] = "types"
        res["detail"] = {c: (spark_types[c], duck_types[c]) for c in s_cols if spark_types[c] != duck_types[c]}
        return res
    a, b = _rows(s_cols, s_rec), _rows(d_cols, d_rec)
    if a == b:
        res["status"] = "match"
    else:
        res["status"] = "values"
        sa, sb = set(a), set(b)
        res["detail"] = {"cols": sorted(s_cols), "only_spark": [list(map(str, x)) for x in list(sa - sb)[:3]],
                         "only_duck": [list(map(str, x)) for x in list(sb - sa)[:3]]}
    return res


def main(argv):
    from tenderlake.plans.registry import QUERIES, load_all
    from tenderlake.session import get_session
    load_all()
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = get_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "error", "detail": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "no-oracle")
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"total": len(names), "bad": bad}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
