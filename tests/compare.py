"""Run registered queries against their DuckDB oracles: ``python tests/compare.py [folder] [name...]``."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return repr(value)


def normal_form(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def _family(name: str) -> str:
    """Type family of a Spark or DuckDB type name."""
    name = str(name).lower()
    for family, parts in {
        "number": ("tinyint", "smallint", "bigint", "hugeint", "integer", "int", "number"),
        "real": ("double", "float", "decimal"),
        "text": ("string", "varchar"),
        "bool": ("bool",),
        "time": ("timestamp", "date"),
    }.items():
        if name.startswith(parts):
            return family
    return name


def differences(spark, connection, query, sql: str, folder: str) -> list[str]:
    """Empty when columns, row count and every value agree."""
    frame = query(spark, folder)
    actual = normal_form(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = normal_form(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return [f"columns {sorted(frame.columns)} != {sorted(columns)}"]
    kinds = {d[0]: _family(d[1]) for d in cursor.description}
    wrong = [f"{n}: {t} != {kinds[n]}" for n, t in frame.dtypes if _family(t) != kinds[n]]
    if wrong:
        return wrong
    if len(actual) != len(expected):
        return [f"{len(actual)} rows != {len(expected)}"]
    return [f"{a} != {e}" for a, e in zip(actual, expected) if a != e][:3]


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = connect(folder), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, connection, query, oracles[name], folder)
            else:
                found = [] if query(spark, folder).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - start:.1f}s", *found, sep="\n     " if found else " ")
    print("failed:", failed)


if __name__ == "__main__":
    main()
