"""Run the named queries and their SQL side by side and report differences.

usage: python tools/compare.py [sample folder] [name prefix ...]
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from runlens.catalog import ORACLE_SQL, QUERIES  # noqa: E402
from runlens.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    """The value with its type, so that 2, 2.0, True and Decimal(2) stay apart."""
    return type(value).__name__, value


def ordered(sql):
    """Whether the statement itself orders its result, so that the order counts."""
    return re.search(r"ORDER BY [^()]*$", sql.strip()) is not None


def normal(columns, rows, in_order=False):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    typed = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), typed if in_order else sorted(typed, key=repr)


def oracle(folder, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    return normal([d[0] for d in cursor.description], cursor.fetchall(), ordered(sql))


def spark_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    return normal(df.columns, [tuple(r) for r in df.collect()], ordered(ORACLE_SQL.get(name, "")))


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.time()
        try:
            columns, rows = spark_rows(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL  {name}: {str(error)[:600]}")
            bad += 1
            continue
        took = time.time() - begun
        if name not in ORACLE_SQL:
            print(f"rows  {name}: {len(rows)} rows, {took:.1f}s")
            continue
        try:
            expected_columns, expected = oracle(folder, ORACLE_SQL[name])
        except Exception as error:  # noqa: BLE001
            print(f"SQL   {name}: {str(error)[:400]}")
            bad += 1
            continue
        if columns != expected_columns:
            print(f"COLS  {name}: {columns} / {expected_columns}")
            bad += 1
        elif rows != expected:
            extra, missing = [r for r in rows if r not in expected][:2], [r for r in expected if r not in rows][:2]
            print(f"DIFF  {name}: {len(rows)} / {len(expected)} rows, ours {extra}, sql {missing}")
            bad += 1
        else:
            print(f"ok    {name}: {len(rows)} rows, {took:.1f}s")
    print(f"{bad} differing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
