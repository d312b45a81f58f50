"""Run queries next to their check SQL: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import oracle_sql
from checks.queries import TABLES, queries


def database(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(repr(tuple(row[at] for at in order)) for row in rows)


def compare(spark, connection, sf_dir, name):
    """Difference between the two answers as text, '' if there is none; and both times."""
    start = time.time()
    frame = queries()[name](spark, sf_dir)
    ours = [tuple(row) for row in frame.collect()]
    spark_time, start = time.time() - start, time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return f"no SQL ({len(ours)} rows)", spark_time, 0
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    theirs = result.fetchall()
    sql_time = time.time() - start
    types = {column[0]: str(column[1]) for column in result.description}
    if sorted(columns) != sorted(frame.columns):
        return f"columns {frame.columns} / {columns}", spark_time, sql_time
    spark_types = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN",
                   "double": "DOUBLE"}
    wrong = [(n, t, types[n]) for n, t in frame.dtypes if spark_types.get(t) != types[n]]
    left, right = normal(ours, frame.columns), normal(theirs, columns)
    note = f"types {wrong} " if wrong else ""
    if left == right:
        return note or f"same ({len(ours)} rows)", spark_time, sql_time
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return (f"{note}DIFFERENT {len(left)} / {len(right)}\n   ours   {only_left}\n   theirs {only_right}",
            spark_time, sql_time)


def main(sf_dir, names):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(sf_dir)
    for name in names or queries():
        try:
            outcome, ours, theirs = compare(spark, connection, sf_dir, name)
            print(f"{name}: {outcome} [{ours:.1f}s / {theirs:.1f}s]", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    main(sys.argv[1], sys.argv[2:])
