"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.session import written

#: Rows of one key that a single task may have in a join.
ROWS_PER_TASK = 1_000_000


def hot_keys(rows: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should have, and over how many tasks (``_salts``) to spread each.

    Counted inside the tasks first, from the key columns alone. There are at most as many as
    ``rows_per_task`` goes into the number of rows.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    return written(counts.select(*on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")), "hot_keys")


def spread_join(
    rows: DataFrame,
    keys: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join many ``rows`` to one row per key; a key too hot for one task is spread over as many as it needs.

    The rows are counted by key first. Without a hot key this is a plain join, which Spark plans
    as it likes. Otherwise each hot key's row of ``keys`` is repeated once per salt and its
    ``rows`` are dealt over the salts by ``spread_by``, columns that vary within a key; all other
    keys have the one salt 0. ``rows`` should be cheap to read twice.
    """
    hot = hot_keys(rows, on, rows_per_task)
    if hot.isEmpty():
        return rows.join(keys, list(on), how)
    hot = F.broadcast(hot)
    dealt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted_rows = rows.join(hot, list(on), "left").withColumn("_salt", dealt).drop("_salts")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    salted_keys = keys.join(hot, list(on), "left").withColumn("_salt", salts).drop("_salts")
    # By the size of ``keys`` before the repetition Spark might broadcast it.
    return salted_rows.join(salted_keys.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def rows_of(rows: DataFrame, reviews: DataFrame, spread_by: Sequence[str] = ("file_path",)) -> DataFrame:
    """The rows that belong to one of ``reviews`` (column review_id)."""
    ids = reviews.select("review_id").distinct()
    return spread_join(rows, ids, ["review_id"], spread_by, "left_semi")


def rows_not_of(
    rows: DataFrame, reviews: DataFrame, spread_by: Sequence[str] = ("file_path",)
) -> DataFrame:
    ids = reviews.select("review_id").distinct()
    return spread_join(rows, ids, ["review_id"], spread_by, "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; every task cuts to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)


def position_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Add each row's place within its key, however many rows a key has.

    The rows are sorted into ranges of (keys, order), so that a hot key lies in many ranges.
    Every range numbers its own rows; a key that goes on in the next range starts there
    at the number of its rows before, and these numbers, one a range, are all that is put
    together. No window holds a key. ``order`` should tell all rows of a key apart.
    """
    key = fresh_name(df, "_key")
    rows = df.withColumn(key, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    # In a range, rows of one key stand side by side, in the order of the key's text.
    ranged = rows.repartitionByRange(F.asc(key), *order).sortWithinPartitions(F.asc(key), *order)
    at = len(rows.columns) - 1

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            names = batch.column(at).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            new = np.append(True, names[1:] != names[:-1])
            begin = np.flatnonzero(new)
            place = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names)))) + 1
            if names[0] == last:
                place[: begin[1] if len(begin) > 1 else len(names)] += count
            last, count = names[-1], int(place[-1])
            arrays = [*batch.columns, pa.array(np.full(len(names), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, f"{key}_part", f"{key}_place"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{key}_part` int", f"`{key}_place` bigint"])
    numbered = written(ranged.mapInArrow(number, schema), "numbered")
    part, place = f"{key}_part", f"{key}_place"
    # Keys cut by the ends of ranges: one row for each range and key comes to the driver.
    ends = numbered.groupBy(part).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(part).collect()
    cut = {a.hi for a, b in zip(ends, ends[1:]) if a.hi == b.lo}
    session, carried = df.sparkSession, []
    if cut:
        broken = F.broadcast(session.createDataFrame([(k,) for k in cut], f"`{key}` string"))
        sizes = numbered.join(broken, key, "left_semi").groupBy(key, part).agg(F.max(place).alias("n"))
        before: dict[str, int] = {}
        for row in sizes.orderBy(part).collect():
            carried.append((row[key], row[part], before.get(row[key], 0)))
            before[row[key]] = before.get(row[key], 0) + row.n
    offsets = session.createDataFrame(carried, f"`{key}` string, `{part}` int, `{key}_before` bigint")
    placed = numbered.join(F.broadcast(offsets), [key, part], "left")
    return placed.select(*df.columns, (F.col(place) + F.coalesce(f"{key}_before", F.lit(0))).alias(name))


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as the frame has columns that begin so."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name
