"""Side-by-side check of a Spark query against its DuckDB oracle (row count, column
names, order-insensitive values). Used by the tests and by ``python -m
trailcast.catalog.check [sf_dir] [keys...]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, round(v, 6) + 0.0)
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (2, float(v))
    if hasattr(v, "isoformat"):
        return (4, str(v).replace("T", " "))
    if isinstance(v, (list, tuple)):
        return (5, tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return (6, tuple(sorted((str(k), _norm(x)) for k, x in v.items())))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return (2, round(float(v), 6))
    except Exception:  # pragma: no cover
        pass
    return (7, str(v))


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    res = {"spark_rows": len(spark_rows), "oracle_rows": len(duck_rows)}
    res["cols_match"] = sorted(spark_cols) == sorted(duck_cols)
    if not res["cols_match"]:
        res["detail"] = f"spark cols {sorted(spark_cols)} vs oracle {sorted(duck_cols)}"
        res["ok"] = False
        return res
    si = [spark_cols.index(c) for c in sorted(spark_cols)]
    di = [duck_cols.index(c) for c in sorted(duck_cols)]
    a = sorted(tuple(_norm(r[i]) for i in si) for r in spark_rows)
    b = sorted(tuple(_norm(r[i]) for i in di) for r in duck_rows)
    res["values_match"] = a == b
    res["ok"] = res["values_match"] and len(a) == len(b)
    if not res["ok"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [r for r in a if r not in sb][:3]
        res["only_oracle"] = [r for r in b if r not in sa][:3]
    return res


def check(spark, sf_dir: str, keys=None, verbose=True):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duckdb_conn(sf_dir)
    out = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if k in sqls:
                cur = con.execute(sqls[k])
                dcols = [d[0] for d in cur.description]
                drows = cur.fetchall()
                r = compare(rows, cols, drows, dcols)
            else:
                r = {"ok": True, "spark_rows": len(rows), "rows_only": True}
            r["spark_sec"] = round(t1 - t0, 2)
        except Exception as e:  # report and continue
            r = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        out[k] = r
        if verbose:
            print(k, r, flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from trailcast.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    res = check(spark, sf, keys)
    bad = [k for k, v in res.items() if not v.get("ok")]
    print("FAILED:", bad)
    print(f"{len(res) - len(bad)}/{len(res)} ok")
