"""Runs queries and their SQL twins side by side: python tests/compare.py SF_DIR [NAME...]"""

import math
import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, dict) or hasattr(v, "asDict"):
        return str(sorted((k, norm(x)) for k, x in (v if isinstance(v, dict) else v.asDict()).items()))
    return str(v)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{where}'")
    return con


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in at) for r in rows), [cols[i] for i in at]


def compare(spark, con, sf_dir, name, f, sql):
    t = time.time()
    df = f(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t = time.time() - t
    if not sql:
        return True, f"{name}: {len(got[0])} rows, no SQL, {t:.1f} s"
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    ok = got == want
    said = f"{name}: {'ok' if ok else 'DIFFERENT'} {len(got[0])} rows, {t:.1f} s"
    if not ok:
        a, b = set(got[0]), set(want[0])
        said += f"\n   columns {got[1]} / {want[1]}; rows {len(got[0])} / {len(want[0])}\n   only here {sorted(a - b)[:3]}\n   only SQL {sorted(b - a)[:3]}"
    return ok, said


if __name__ == "__main__":
    import __spark_entry__ as entry
    from orrery.session import build_session

    spark = build_session("local[8]", 8)
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    sqls, bad = entry.oracle_sql(), []
    wanted = sys.argv[2:]
    for name, f in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, said = compare(spark, con, sys.argv[1], name, f, sqls.get(name))
        except Exception as e:
            ok, said = False, f"{name}: FAILED {type(e).__name__} {str(e)[:700]}"
        if not ok:
            bad.append(name)
        print(said, flush=True)
    print("bad:", bad)
