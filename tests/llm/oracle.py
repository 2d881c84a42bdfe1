"""Runs a query and its SQL over the same tables."""

import os

import duckdb

from lintmill.llm.oracles import ORACLES
from lintmill.llm.queries import QUERIES


def rows_of(frame):
    return sorted(map(repr, (tuple(r) for r in frame)))


def compare(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            connection.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    result = QUERIES[name](spark, sf_dir)
    found = rows_of(result.collect())
    columns = ", ".join(result.columns)
    expected = rows_of(connection.execute(f"select {columns} from ({ORACLES[name]})").fetchall())
    assert found == expected
