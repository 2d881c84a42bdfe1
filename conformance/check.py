"""Run registered queries against their oracles: python -m conformance.check [dir] [names]."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

from conformance.oracles import ORACLES
from conformance.queries import QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normalised(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    mine = normalised(df.columns, df.collect())
    relation = connection.sql(ORACLES[name])
    wanted = normalised(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    if mine == wanted:
        return True, f"{mine.total()} rows"
    only_mine, only_wanted = mine - wanted, wanted - mine
    return False, (
        f"{mine.total()} rows against {wanted.total()}; {only_mine.total()} only here, e.g. "
        f"{list(only_mine)[:2]}; {only_wanted.total()} only there, e.g. {list(only_wanted)[:2]}"
    )


def main() -> None:
    from lintmill.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection, bad = local_session(), oracle_connection(sf_dir), 0
    for name in names:
        started = time.time()
        if name not in ORACLES:
            print(f"{name:26s} no oracle", flush=True)
            continue
        try:
            ok, detail = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, detail = False, str(error)[:600]
        bad += not ok
        print(f"{name:26s} {'ok ' if ok else 'BAD'} {time.time() - started:6.1f}s {detail[:700]}", flush=True)
    print("all agree" if not bad else f"{bad} disagree")


if __name__ == "__main__":
    main()
