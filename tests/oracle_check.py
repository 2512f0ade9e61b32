"""Run every registered query in Spark and its oracle SQL in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, sorted column names and an order-insensitive hash of the
values (doubles rounded), like the driver's correctness gate.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<nan>"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bytes):
        return v.hex()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def frame_digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return sorted(columns), len(rows), h, lines


def main():
    import duckdb

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    from leadsmith.session import build_session

    ckpt = tempfile.mkdtemp(prefix="ckpt-", dir="/tmp")
    spark = build_session("oracle-check", master="local[8]", shuffle_partitions=8,
                          checkpoint_dir=ckpt)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    report = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "spark_error", "error": str(e)[:2000]}
            print(name, "SPARK ERROR", str(e)[:2000])
            continue
        dt = time.time() - t0
        if name not in sql:
            report[name] = {"status": "no_oracle", "rows": len(srows), "sec": round(dt, 2)}
            print(f"{name:32s} rows={len(srows):7d}  (no oracle)  {dt:.1f}s")
            continue
        try:
            cur = con.execute(sql[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "oracle_error", "error": str(e)[:2000]}
            print(name, "ORACLE ERROR", str(e)[:2000])
            continue
        sc, sn, sh, sl = frame_digest(scols, srows)
        dc, dn, dh, dl = frame_digest(dcols, drows)
        ok = sc == dc and sn == dn and sh == dh
        report[name] = {"status": "match" if ok else "MISMATCH", "rows": sn, "oracle_rows": dn,
                        "cols": sc == dc, "sec": round(dt, 2)}
        print(f"{name:32s} rows={sn:7d} oracle={dn:7d} cols={'ok' if sc == dc else 'DIFF'} "
              f"{'MATCH' if ok else 'MISMATCH'}  {dt:.1f}s")
        if not ok:
            if sc != dc:
                print("   spark cols:", sc, "\n   oracle cols:", dc)
            only_s = sorted(set(sl) - set(dl))[:5]
            only_d = sorted(set(dl) - set(sl))[:5]
            print("   only spark:", only_s)
            print("   only oracle:", only_d)
    bad = [k for k, v in report.items() if v["status"] not in ("match", "no_oracle")]
    print(json.dumps({"total": len(report), "bad": bad}))
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
