"""Run registered queries against their SQL twins: ``python -m tests.compare [sf] [name ...]``."""

import sys
import time

import duckdb

from checks import ORACLE, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def check(spark, con, sf, name):
    t0 = time.time()
    df = QUERIES[name](spark, sf)
    got = df.collect()
    t1 = time.time()
    if name not in ORACLE:
        return len(got), t1 - t0, 0.0, "rows-only" if got else "EMPTY"
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return len(got), t1 - t0, t2 - t1, f"COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return len(got), t1 - t0, t2 - t1, "ok" if a else "ok-EMPTY"
    sa, sb = set(a), set(b)
    only_a, only_b = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
    return len(got), t1 - t0, t2 - t1, f"DIFF {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}"


def main():
    import __spark_entry__ as e
    from momentlake.skew import session
    e.queries()
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for p in names for n in (QUERIES if p == "all" else [q for q in QUERIES if q == p or (p.endswith("*") and q.startswith(p[:-1]))])]
    spark, con = session(), oracle(sf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        try:
            r = check(spark, con, sf, n)
        except Exception as ex:  # keep going so that one report covers every query
            r = (0, 0, 0, "ERROR " + str(ex)[:1500])
        good = r[3] in ("ok", "rows-only")
        bad += not good
        print(f"{n:28s} rows={r[0]:<8d} spark={r[1]:6.2f}s sql={r[2]:6.2f}s {r[3]}", flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main()
