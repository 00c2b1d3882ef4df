"""Runs queries and their oracle SQL side by side: ``python -m checkset.compare [names]``."""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from checkset import oracle, registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (Decimal, datetime)):
        return f"{type(value).__name__} {value}"
    return value


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted; types that differ stay different."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    kept = [tuple(_plain(row[i]) for i in order) for row in values]
    return sorted(kept, key=lambda row: tuple(map(repr, row)))


def difference(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    result = registry.QUERIES[name](spark, sf_dir)
    ours = rows(result.columns, [tuple(row) for row in result.collect()])
    cursor = connection.execute(oracle.statements()[name])
    their_names = [column[0] for column in cursor.description]
    theirs = rows(their_names, cursor.fetchall())
    if sorted(result.columns) != sorted(their_names):
        return f"columns {sorted(set(result.columns) ^ set(their_names))}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, oracle {len(theirs)}"
    for mine, other in zip(ours, theirs, strict=True):
        if mine != other:
            cells = [
                (column, a, b)
                for column, a, b in zip(sorted(their_names), mine, other, strict=True)
                if a != b
            ]
            return f"cells {cells[:3]}"
    return None


def main() -> None:
    sf_dir = "/root/testdata/sf0.01"
    names = sys.argv[1:] or list(registry.QUERIES)
    if names[0].startswith("/"):
        sf_dir, names = names[0], names[1:] or list(registry.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, connection, sf_dir, name)
        except Exception as error:  # keep going: one broken query must not hide the rest
            found = f"{type(error).__name__} {str(error)[:400]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {found or ''}")
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
