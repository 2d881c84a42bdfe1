"""Catalogue tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.schemas import AI_RESPONSES, COLUMN_DEFAULTS, TABLES
from lintmill.sources.runs import BUCKETED, read_children, tombstones

def read_table(spark: SparkSession, folder: str, name: str, review_id: str | None = None) -> DataFrame:
    """A catalogue table with its declared schema; nothing is inferred.

    Of a review's children the rows of its last finished run count.  With ``review_id``
    only that review's bucket is read.  Deleted reviews, and what hangs on them, are not there.
    """
    if name in BUCKETED:
        return backfill(name, read_children(spark, folder, name, review_id))
    rows = backfill(name, spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}"))
    if name == "reviews":
        rows = rows.join(tombstones(spark, folder).select(F.col("review_id").alias("id")), "id", "left_anti").select(*rows.columns)
        return rows if review_id is None else rows.where(F.col("id") == review_id)
    return rows


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Model answers as JSON lines, each with review_id and the raw answer text."""
    return spark.read.schema(AI_RESPONSES).json(path)


def read_catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in TABLES}


def backfill(name: str, df: DataFrame) -> DataFrame:
    """Bring rows of an older snapshot to the present schema.

    Missing columns appear, null or with the value their absence meant.
    """
    present = set(df.columns)
    defaults = COLUMN_DEFAULTS.get(name, {})
    columns = []
    for field in TABLES[name].fields:
        value = F.col(field.name) if field.name in present else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def merge_snapshots(name: str, *snapshots: DataFrame) -> DataFrame:
    """Old and new snapshots of a table as one."""
    merged = snapshots[0]
    for snapshot in snapshots[1:]:
        merged = merged.unionByName(snapshot, allowMissingColumns=True)
    return backfill(name, merged)
