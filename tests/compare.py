"""Run queries and their SQL twins side by side: ``python tests/compare.py SF_DIR [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(value) + 0.0
    return value


def canonical(names, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=repr)


def spark_rows(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def differences(spark_result, sql_result):
    if spark_result[0] != sql_result[0]:
        return f"columns {spark_result[0]} != {sql_result[0]}"
    if len(spark_result[1]) != len(sql_result[1]):
        return f"rows {len(spark_result[1])} != {len(sql_result[1])}"
    wrong = [(a, b) for a, b in zip(spark_result[1], sql_result[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from repopulse.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = connect(sf_dir), oracle_sql(), 0
    for name, function in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            found = spark_rows(function(spark, sf_dir))
            seconds = time.time() - started
            problem = differences(found, sql_rows(connection, oracles[name])) if name in oracles else "no SQL"
        except Exception as error:  # report and go on with the next query
            problem, seconds, found = f"{type(error).__name__}: {str(error)[:600]}", time.time() - started, ([], [])
        failed += problem is not None
        print(f"{name:26s} {seconds:6.2f}s {len(found[1]):7d} rows {problem or 'ok'}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
