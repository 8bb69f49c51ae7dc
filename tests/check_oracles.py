"""Run registered queries against their SQL twins: check_oracles.py SF [name...]."""

import sys
import time

import conftest  # noqa: F401  (sets the import path)
from compare import connect, duck_rows, spark_rows
from pyspark.sql import SparkSession

import __spark_entry__ as entry


def main():
    sf, *names = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_rows(build(spark, sf_dir))
            took = time.time() - start
            if name not in sqls:
                print(f"{name}: no twin, {len(got[1])} rows, {took:.1f}s")
                continue
            want = duck_rows(con, sqls[name])
            ok = got == want
            bad += not ok
            print(f"{name}: {'ok' if ok else 'DIFFERENT'} {len(got[1])} rows, {took:.1f}s", flush=True)
            if not ok:
                print("   columns", got[0], want[0], len(want[1]))
                print("   spark only", list(set(got[1]) - set(want[1]))[:2])
                print("   duckdb only", list(set(want[1]) - set(got[1]))[:2])
        except Exception as problem:
            bad += 1
            print(f"{name}: ERROR {str(problem)[:1500]}", flush=True)
    print("differing or failing:", bad, "missing twins:", sorted(set(entry.queries()) - set(sqls)), "orphans:", sorted(set(sqls) - set(entry.queries())))


main()
