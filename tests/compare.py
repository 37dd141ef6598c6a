"""Compare registered queries with their SQL: python -m tests.compare SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def sql_rows(sf_dir: str, sql: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    result = connection.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows])


def difference(df, sf_dir: str, sql: str) -> str | None:
    names, rows = _canonical(df.columns, [tuple(r) for r in df.collect()])
    sql_names, expected = _canonical(*sql_rows(sf_dir, sql))
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for row, other in zip(rows, expected):
        if row != other:
            return f"{row} != {other}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, *wanted = sys.argv[1:]
    known = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in known:
                verdict = difference(df, folder, known[name]) or "ok"
            else:
                verdict = f"{df.count()} rows"
        except Exception as error:  # noqa: BLE001 - report every query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name}: {verdict} ({time.time() - start:.1f} s)", flush=True)
