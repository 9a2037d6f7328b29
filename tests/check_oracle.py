"""Run queries next to their SQL and report differences: python tests/check_oracle.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from signalgrid.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SQL_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sf_dir: str, sql: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    types = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall(), types


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    frame = spark_entry.queries()[name](spark, sf_dir)
    got = frame.collect()
    took = time.time() - start
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.2f}s"
    columns, wanted, types = sql_rows(sf_dir, sql)
    ours = {f.name: SQL_TYPES[f.dataType.simpleString()] for f in frame.schema}
    if ours != types:
        return False, f"columns {ours} != {types}"
    a, b = rows_of(frame.columns, got), rows_of(columns, wanted)
    if a == b:
        return True, f"{len(a)} rows, {took:.2f}s"
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return False, f"{len(a)} vs {len(b)} rows; spark {only_a} sql {only_b}"


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(spark_entry.queries())
    session = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for query in names:
        try:
            good, note = compare(session, f"/root/testdata/sf{scale}", query)
        except Exception as error:  # report and go on with the other queries
            good, note = False, str(error)[:600]
        bad += not good
        print("ok  " if good else "BAD ", query, note[:900], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
