"""Compare every registered query with its SQL on the same tables (development aid)."""

import sys
import time

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
from quorate.plans.registry import load  # noqa: E402
from quorate.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    import datetime
    import decimal
    import math
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    rows = [tuple(normal(v) for v in r) for r in zip(*cols)]
    return names, sorted(rows, key=repr), {n: str(arrow.schema.field(n).type) for n in names}


def compare(spark, folder, name, fn, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    t0 = time.time()
    got = fn(spark, folder).toArrow()
    took = time.time() - t0
    n1, r1, s1 = rows_of(got)
    if sql is None:
        return took, len(r1), "rows-only"
    n2, r2, s2 = rows_of(con.sql(sql).to_arrow_table())
    if n1 != n2:
        return took, len(r1), f"COLUMNS {n1} vs {n2}"
    loose = {"large_string": "string"}
    types = [f"{k}:{s1[k]}/{s2[k]}" for k in s1 if loose.get(s1[k], s1[k]) != loose.get(s2[k], s2[k])]
    note = (" types " + ",".join(types)) if types else ""
    if len(r1) != len(r2):
        return took, len(r1), f"ROWS {len(r1)} vs {len(r2)}" + note + f" {r1[:2]} {r2[:2]}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return took, len(r1), f"VALUES {len(bad)} differ, e.g. {bad[0]}" + note
    return took, len(r1), "ok" + note


if __name__ == "__main__":
    folder = "/root/testdata/sf0.01"
    pats = sys.argv[1:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, (fn, sql) in load().items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            took, n, res = compare(spark, folder, name, fn, sql)
        except Exception as exc:
            took, n, res = 0.0, -1, "ERROR " + str(exc)[:500]
        ok = res.startswith("ok") or res == "rows-only"
        bad += not ok
        print(f"{'   ' if ok else '!! '}{name:42s} {took:6.2f}s n={n:<8d} {res[:900]}", flush=True)
    print("bad:", bad)
