"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.session import written

__all__ = ["broadcast_if_small", "fresh", "key_of", "let", "lower_ascii", "slices", "table", "written"]

#: A side is broadcast only if its measured size stays below this many bytes.
BROADCAST_BYTES = 64 << 20

#: Python tasks take up about this many bytes of text at a time.
SLICE_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row.

    A plain column would be inlined by the optimizer wherever it is used, also
    inside lambdas, and computed there again for every element.
    """
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def key_of(*columns: Column) -> Column:
    """A 128-bit key of the values; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in columns]
    joined = F.concat_ws("\u0000", *parts)
    return F.md5(joined)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """The frame with a broadcast hint if its measured size is below the bound.

    ``df`` should be cheap to read twice (a written table). Beyond the bound
    Spark joins by shuffle, and adaptive execution splits its skewed keys.
    """
    size = df.agg(F.coalesce(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes (of a list: elements) in the column."""
    values, size, start = batch.column(column), 0, 0
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    for i, n in enumerate(length(values).to_pylist()):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            size, start = 0, i + 1
    if start < batch.num_rows:
        yield batch.slice(start)
