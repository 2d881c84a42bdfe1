"""Catalogue queries: look-ups, lists, latest reviews, dashboard."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators.joins import first_per_key, position_within, rows_of



def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


class ReviewDetail(NamedTuple):
    """A review's row and its children; the children stay rows, however many."""

    review: DataFrame
    issues: DataFrame
    file_results: DataFrame


def review_detail(
    reviews: DataFrame,
    issues: DataFrame,
    file_results: DataFrame,
    review_id: str | None = None,
    user_id: str | None = None,
) -> ReviewDetail:
    """Reviews by id and owner (all when not given) with their children."""
    if review_id is not None:
        reviews = reviews.where(F.col("id") == review_id)
        issues = issues.where(F.col("review_id") == review_id)
        file_results = file_results.where(F.col("review_id") == review_id)
    if user_id is not None:
        reviews = reviews.where(F.col("user_id") == user_id)
    ids = reviews.select(F.col("id").alias("review_id"))
    return ReviewDetail(reviews, rows_of(issues, ids), rows_of(file_results, ids))


def review_overview(detail: ReviewDetail) -> DataFrame:
    """One row per review with the numbers of its children, each counted before the join."""
    n_issues = detail.issues.groupBy("review_id").agg(F.count("*").alias("_issues"))
    n_files = detail.file_results.groupBy("review_id").agg(F.count("*").alias("_files"))
    return (
        detail.review.withColumnRenamed("id", "review_id")
        .join(n_issues, "review_id", "left")
        .join(n_files, "review_id", "left")
        .withColumn("issues_loaded", F.coalesce("_issues", F.lit(0)))
        .withColumn("files_loaded", F.coalesce("_files", F.lit(0)))
        .drop("_issues", "_files")
    )


def ready_gate(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Say for each (user_id, repository_id) whether an analysis may start.

    Outcomes: ready, not_ready, not_found (also for another user's repository).
    """
    known = repositories.select(
        F.col("id").alias("repository_id"), "user_id", "status", "local_path"
    )
    joined = requests.join(known, ["repository_id", "user_id"], "left")
    usable = (F.col("status") == "ready") & (F.coalesce("local_path", F.lit("")) != "")
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when(usable, "ready").otherwise("not_ready")
    )
    return joined.withColumn("outcome", outcome).drop("status", "local_path")


def latest_reviews(reviews: DataFrame, by_type: bool = False) -> DataFrame:
    """The newest review per repository and user, and per type when asked; any status."""
    keys = ["repository_id", "user_id", *(["review_type"] if by_type else [])]
    return first_per_key(reviews, keys, _newest_first()).drop("_rank")


def list_reviews(reviews: DataFrame, repository_id: str, user_id: str) -> DataFrame:
    """One repository's reviews, newest first."""
    mine = (F.col("repository_id") == repository_id) & (F.col("user_id") == user_id)
    return reviews.where(mine).orderBy(*_newest_first())


def list_repositories(repositories: DataFrame, user_id: str) -> DataFrame:
    """One user's repositories, newest first."""
    return repositories.where(F.col("user_id") == user_id).orderBy(*_newest_first())


def reviews_in_order(reviews: DataFrame) -> DataFrame:
    """Every repository's list at once: reviews with their place in it."""
    return position_within(reviews, ["user_id", "repository_id"], _newest_first())


def repositories_in_order(repositories: DataFrame) -> DataFrame:
    """Every user's list at once: repositories with their place in it."""
    return position_within(repositories, ["user_id"], _newest_first())


def list_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"))


def dashboard(repositories: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per user: repositories, ready ones, and open issues of their latest reviews."""
    latest = latest_reviews(reviews).select(
        F.col("repository_id").alias("id"), "user_id", F.col("issues_count").alias("_issues")
    )
    ready = F.col("status") == "ready"
    return (
        repositories.select("id", "user_id", "status")
        .join(latest, ["id", "user_id"], "left")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("repositories_added"),
            F.count_if(ready).alias("repositories_ready"),
            F.sum(F.when(ready, F.coalesce("_issues", F.lit(0))).otherwise(0)).alias("total_issues"),
        )
    )
