"""Writing reviews, their children and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.operators.joins import rows_not_of
from lintmill.operators.maintenance import stable_id
from lintmill.schemas import DEFAULT_SETTINGS
from lintmill.sources.runs import append_rows, name_run


def create_reviews(requests: DataFrame, at: Column) -> DataFrame:
    """New review rows for (repository_id, user_id, review_type, status).

    An AI review records the model of its user where ``ai_model`` is given.
    """
    model = F.col("ai_model") if "ai_model" in requests.columns else F.lit(DEFAULT_SETTINGS["ollama_model"])
    return requests.select(
        stable_id("user_id", "repository_id", "review_type", at.cast("string")).alias("id"),
        "repository_id",
        "user_id",
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("review_type", F.lit("static")).alias("review_type"),
        F.when(F.col("review_type") == "ai", model).alias("ai_model"),
        F.lit(None).cast("string").alias("report_markdown"),
        F.lit(0).alias("files_analyzed"),
        F.lit(0).alias("issues_count"),
        F.lit(0.0).alias("overall_score"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("error_message"),
        F.when(F.col("status") == "running", at).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        at.alias("created_at"),
    )


def replace_children(old: DataFrame, new: DataFrame, finished: DataFrame) -> DataFrame:
    """All rows of finished reviews (review_id) give way to the new ones."""
    return rows_not_of(old, finished).select(*old.columns).unionByName(new.select(*old.columns))


def finish_reviews(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Write results (review_id, status, files_analyzed, issues_count, overall_score,
    summary, error_message, completed_at, ai_model, report_markdown) into review rows.

    The model and the stored report change only when the result has one.
    """
    changed = ["status", "files_analyzed", "issues_count", "overall_score", "summary",
               "error_message", "completed_at"]
    kept_if_null = ["ai_model", "report_markdown"]
    renamed = results.select(
        F.col("review_id").alias("id"),
        *[F.col(c).alias(f"_{c}") for c in [*changed, *kept_if_null]],
        F.lit(True).alias("_done"),
    )
    joined = reviews.join(renamed, "id", "left")

    def value(c: str) -> Column:
        if c in changed:
            return F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        if c in kept_if_null:
            return F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
        return F.col(c)

    return joined.select(*[value(c) for c in reviews.columns])


def write_children(df: DataFrame, folder: str, name: str, finished: DataFrame) -> None:
    """Add issues or file results as one run, which replaces all earlier rows of ``finished``
    (review_id), also of those that have no rows now.

    First the rows are appended, in buckets by review; then one row for each review
    names the run (see ``runs``).  A job that stops in between leaves the old state, and
    nothing that is stored is rewritten.
    """
    name_run(finished, folder, name, append_rows(df, folder, name))


def replace_results(
    spark: SparkSession, folder: str, name: str, new: DataFrame, finished: DataFrame
) -> None:
    """The children of finished reviews give way to ``new``, also where there are none."""
    write_children(new, folder, name, finished)


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Reports (see ``report_bundle``) by format; the parts of one lie in order."""
    reports.hint("rebalance", "format", "review_id").sortWithinPartitions(
        "review_id", "section", "rank", "path_key"
    ).write.mode(mode).partitionBy("format").parquet(path)
