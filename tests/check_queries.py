"""Compare registered queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return ("f", str(v))
        v = round(v, 6)
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, int):
        return ("f", float(v))
    if v is None:
        return ("", "")
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    return ("s", str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, sf_dir, name, con):
    from sparkfolio.plans import catalog

    t = time.time()
    df = catalog.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return f"{name}: NO SQL {len(got)} rows, {spark_s:.1f}s", False, got
    t = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    duck_s = time.time() - t
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of([d[0] for d in cur.description], want)
    ok = gc == wc and gr == wr and len(gr) > 0
    note = ""
    if not ok:
        note = f"\n   cols {gc} vs {wc}; rows {len(gr)} vs {len(wr)}"
        for a in [x for x in gr if x not in set(wr)][:3]:
            note += f"\n   spark {str(a)[:600]}"
        for a in [x for x in wr if x not in set(gr)][:3]:
            note += f"\n   sql   {str(a)[:600]}"
    return f"{name}: {'ok' if ok else 'DIFF'} {len(gr)} rows, spark {spark_s:.1f}s sql {duck_s:.1f}s{note}", ok, got


def connect(sf_dir):
    con = duckdb.connect()
    for tb in TABLES:
        con.execute(f"CREATE VIEW {tb} AS SELECT * FROM '{sf_dir}/{tb}.parquet'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from sparkfolio.plans import catalog

    con, bad = connect(sf), 0
    for n in args[1:] or list(catalog.queries()):
        try:
            msg, ok, got = compare(spark, sf, n, con)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"{n}: ERROR {str(e)[:500]}", False
        print(msg, flush=True)
        bad += not ok
    print("failures:", bad)
