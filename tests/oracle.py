"""Runs registered queries beside their SQL: python -m tests.oracle [SF_DIR] [NAME...]."""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sequenced_events log_segments deliveries tracking_runs eval_items".split()


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), sorted(names)


def compare(spark, d, name, run, sql):
    df = run(spark, d)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    cur = connect(d).execute(sql)
    want = rows_of(cur.fetchall(), [x[0] for x in cur.description])
    return got, want


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(qs), set(sqls) - set(qs)
    for name in sys.argv[2:] or qs:
        t = time.time()
        try:
            if name not in sqls:
                print(f"{name:32} no sql  {qs[name](spark, d).count():8} rows {time.time() - t:6.1f} s", flush=True)
                continue
            got, want = compare(spark, d, name, qs[name], sqls[name])
            same = got == want
            print(f"{name:32} {'ok' if same else 'DIFFERS'} {len(got[0]):8} rows {time.time() - t:6.1f} s", flush=True)
            if not same:
                print(got[1], want[1], len(want[0]), [x for x in got[0] if x not in want[0]][:3] if len(got[0]) < 5000 else got[0][:3], [x for x in want[0] if x not in got[0]][:3] if len(got[0]) < 5000 else want[0][:3])
        except Exception as ex:
            print(f"{name:32} ERROR {str(ex)[:600]}", flush=True)
