"""Children of reviews on disk: appended runs, deletions without rewriting, compaction.

``<name>/review_bucket=B/run=R`` holds rows; nothing in it is ever changed. ``<name>_runs`` names,
for each review, its last finished run and the folder (``stored``) that holds it: rows in any
other folder are not seen. ``deleted_reviews`` holds tombstones: ids of deleted reviews and
when. All three only grow by whole appended files, so a job that stops leaves what
was there before.

A compaction copies the rows that are seen of those buckets that hold others as well into one new
folder and then names that folder for the same runs. It never claims a later run than the one it
copied, so a writer that finishes meanwhile, whenever it began, still wins. What is not
seen any more is removed by ``vacuum``, later, when no reader or writer needs it.

Rows that were stored before there were runs lie right in ``<name>/review_bucket=B`` and
count as run 0 of their reviews.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.operators.maintenance import identified
from lintmill.schemas import TABLES

BUCKETS = 512
BUCKETED = ("review_issues", "file_analysis_results")
RUNS = "review_id string, run long, stored long"
TOMBSTONES = "review_id string, run long"


def review_bucket(review_id: Column) -> Column:
    """The folder number that a review's children lie in."""
    return F.pmod(F.xxhash64(review_id), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, schema: T.StructType | str, *paths: str, base: str | None = None) -> DataFrame:
    """The files at the paths; none of them need be there."""
    rows = spark.createDataFrame([], schema)
    for path in paths:
        reader = spark.read.schema(schema)
        try:
            rows = rows.unionByName((reader.option("basePath", base) if base else reader).parquet(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return rows


def _stored(spark: SparkSession, folder: str, name: str, buckets: list[int] | None = None) -> DataFrame:
    """All rows, seen or not, with review_bucket and run (0 before there were runs)."""
    fields = [*TABLES[name].fields, T.StructField("review_bucket", T.IntegerType())]
    base = f"{folder}/{name}"
    at = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
    rows = _read(spark, T.StructType([*fields, T.StructField("run", T.LongType())]), f"{base}/review_bucket={at}/run=*", base=base)
    old = _read(spark, T.StructType(fields), f"{base}/review_bucket={at}/*.parquet", base=base)
    return rows.unionByName(old.withColumn("run", F.lit(0).cast("long")))


def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """(review_id, run): when a review was deleted last."""
    return _read(spark, TOMBSTONES, f"{folder}/deleted_reviews").groupBy("review_id").agg(F.max("run").alias("run"))


def seen(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(review_id, run, stored) of every review with a named run or a tombstone; a deleted one's ``stored`` is null.

    Reviews that are not here have the rows of run 0, if any.
    """
    runs = _read(spark, RUNS, f"{folder}/{name}_runs")
    last = runs.groupBy("review_id").agg(F.max(F.struct("run", F.coalesce("stored", "run").alias("stored"))).alias("_last"))
    gone = tombstones(spark, folder).withColumnRenamed("run", "_gone")
    both = last.join(gone, "review_id", "full_outer")
    run = F.coalesce("_last.run", F.lit(0))
    return both.select("review_id", run.alias("run"), F.when(F.coalesce(F.col("_gone") < run, F.lit(True)), F.coalesce("_last.stored", F.lit(0))).alias("stored"))


def read_children(spark: SparkSession, folder: str, name: str, review_id: str | None = None) -> DataFrame:
    """The rows that are seen, of all reviews or, from its bucket alone, of one."""
    state = seen(spark, folder, name).withColumn("_known", F.lit(True))
    if review_id is None:
        rows = _stored(spark, folder, name)
    else:
        [at] = spark.range(1).select(review_bucket(F.lit(review_id)).alias("b")).collect()
        mine = F.col("review_id") == review_id
        rows = _stored(spark, folder, name, [at.b]).where((F.col("review_bucket") == at.b) & mine)
        state = state.where(mine)
    # The buckets take part in the join, so that rows read by bucket are matched there.
    return _visible(rows, state).select(*[f.name for f in TABLES[name].fields if f.name in rows.columns])


def _visible(rows: DataFrame, state: DataFrame) -> DataFrame:
    joined = rows.join(state.select("review_id", "stored", "_known"), "review_id", "left")
    return joined.where(F.when(F.col("_known"), F.col("run") == F.col("stored")).otherwise(F.col("run") == 0))


def append_rows(df: DataFrame, folder: str, name: str) -> int:
    """Store rows, with their ids, as a new run, which nobody sees yet.

    Rebalancing gives each bucket few files and lets adaptive execution split a bucket
    that one huge review fills over as many writers as its size asks for.
    """
    run = time.time_ns()
    rows = identified(df, name).withColumn("review_bucket", review_bucket(F.col("review_id"))).withColumn("run", F.lit(run))
    rows.hint("rebalance", "review_bucket").write.mode("append").partitionBy("review_bucket", "run").parquet(f"{folder}/{name}")
    return run


def name_run(reviews: DataFrame, folder: str, name: str, run: int) -> None:
    """From now on the run's rows are those of ``reviews`` (review_id), also where it has none."""
    named = reviews.select("review_id").distinct().select("review_id", F.lit(run).alias("run"), F.lit(run).alias("stored"))
    named.write.mode("append").parquet(f"{folder}/{name}_runs")


def delete_reviews(reviews: DataFrame, folder: str) -> None:
    """Deleted reviews (id) lose their rows and children at once; only their ids are written."""
    gone = reviews.select(F.col("id").alias("review_id")).distinct().withColumn("run", F.lit(time.time_ns()))
    gone.write.mode("append").parquet(f"{folder}/deleted_reviews")


def compact(spark: SparkSession, folder: str, name: str) -> int:
    """Rewrite the buckets that hold rows nobody sees, or several runs; returns how many.

    Bucket numbers are the only thing that comes to the driver.
    """
    state = seen(spark, folder, name).withColumn("_known", F.lit(True))
    held = _stored(spark, folder, name).select("review_bucket", "run").distinct()
    # A bucket is in order if it has one folder and that folder is what all its known reviews point to.
    pointed = state.where(F.col("stored").isNotNull()).select(review_bucket(F.col("review_id")).alias("review_bucket"), F.col("stored").alias("run")).distinct()
    gone = state.where(F.col("stored").isNull()).select(review_bucket(F.col("review_id")).alias("review_bucket")).distinct()
    several = held.groupBy("review_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("review_bucket")
    unseen = held.where(F.col("run") > 0).join(pointed, ["review_bucket", "run"], "left_anti").select("review_bucket")
    old = held.where(F.col("run") == 0).select("review_bucket")
    dirty = several.unionByName(unseen).unionByName(old).unionByName(gone.join(held, "review_bucket", "left_semi"))
    buckets = sorted(r.review_bucket for r in dirty.distinct().collect())  # BUCKETS at most
    if not buckets:
        return 0
    copied = time.time_ns()
    rows = _visible(_stored(spark, folder, name, buckets), state).drop("_known", "stored")
    # Rows from before they had ids get theirs here.
    kept = rows.drop("run")
    ids = identified(kept.drop("review_bucket"), name).withColumn("review_bucket", review_bucket(F.col("review_id")))
    ids.withColumn("run", F.lit(copied)).hint("rebalance", "review_bucket").write.mode("append").partitionBy("review_bucket", "run").parquet(f"{folder}/{name}")
    # The same runs as before, at another place. Reviews of run 0 get their first name here.
    nameless = rows.select("review_id").distinct().join(state, "review_id", "left_anti").select("review_id", F.lit(0).cast("long").alias("run"))
    named = state.where(F.col("stored").isNotNull() & review_bucket(F.col("review_id")).isin(buckets)).select("review_id", "run")
    moved = named.unionByName(nameless).withColumn("stored", F.lit(copied))
    moved.write.mode("append").parquet(f"{folder}/{name}_runs")
    return len(buckets)


def vacuum(spark: SparkSession, folder: str, name: str, before: int) -> int:
    """Remove folders of runs older than ``before`` (nanoseconds) that no review points to; returns how many.

    ``before`` must lie so far back that no reader still reads and no writer still writes them.
    """
    state = seen(spark, folder, name)
    pointed = state.where(F.col("stored").isNotNull()).select(review_bucket(F.col("review_id")).alias("review_bucket"), F.col("stored").alias("run")).distinct()
    held = _stored(spark, folder, name).select("review_bucket", "run").distinct()
    unused = held.where((F.col("run") > 0) & (F.col("run") < before)).join(pointed, ["review_bucket", "run"], "left_anti")
    hadoop, gone = spark._jvm.org.apache.hadoop.fs, 0
    for row in unused.toLocalIterator():
        path = hadoop.Path(f"{folder}/{name}/review_bucket={row.review_bucket}/run={row.run}")
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
