"""One job from source folders to stored, searchable reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.operators.catalogue import ready_gate
from lintmill.operators.text_index import TextIndex, issue_texts, own_texts
from lintmill.plans.export import store_markdown
from lintmill.plans.static_review import DETECTORS, Detector, run_static_review
from lintmill.session import written
from lintmill.sources.corpus import read_corpus
from lintmill.sources.sinks import create_reviews, finish_reviews, write_children
from lintmill.sources.tables import read_table


def review_corpus(
    spark: SparkSession,
    root: str,
    folder: str,
    requests: DataFrame,
    at: Column,
    repository_depth: int = 1,
    settings: DataFrame | None = None,
    detectors: dict[str, Detector] = DETECTORS,
) -> DataFrame:
    """Review the repositories that ``requests`` (repository_id, user_id) name; returns the requests with their outcome.

    ``folder`` has the catalogue; a repository's ``local_path`` lies ``repository_depth`` parts below ``root``.
    Requests for repositories that are not ready, or not the user's, get no review and say why.

    The steps are written one after the other, each whole: issues and file results become
    seen when their run is named, the index when its run is, and the review rows come last. A job that
    stops can be run again; until then no review names what it left. ``at`` must be a literal: it is part of
    the reviews' ids, so that a repeated job stores the same ones.
    """
    repositories = read_table(spark, folder, "repositories")
    gated = ready_gate(requests.select("repository_id", "user_id").distinct(), repositories)
    gated = written(gated, "requests")
    ready = gated.where(F.col("outcome") == "ready").drop("outcome")
    asked = ready.withColumns({"review_type": F.lit("static"), "status": F.lit("running")})
    reviews = written(create_reviews(asked, at), "new_reviews")

    # Where each new review's files are: the last parts of its repository's path.
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    places = repositories.select(F.col("id").alias("repository_id"), F.substr("local_path", F.lit(len(plain) + 2)).alias("repository_path"), F.startswith("local_path", F.lit(plain + "/")).alias("_inside"))
    places = places.where("_inside").drop("_inside")
    owners = reviews.select(F.col("id").alias("_review"), "repository_id", "user_id").join(places, "repository_id")
    owners = written(owners.select("repository_path", "user_id", "_review"), "review_places")
    # A repository under review twice at once is read once, under the limits of one of its users.
    read_for = owners.groupBy("repository_path").agg(F.min("user_id").alias("user_id"))
    files = read_corpus(spark, root, None, repository_depth, read_for, settings, only_owned=True)
    placed = files.withColumnRenamed("review_id", "repository_path").join(owners.select("repository_path", F.col("_review").alias("review_id")), "repository_path")
    done = run_static_review(placed.select("review_id", "file_path", "language", "content"), reviews, repositories, at, detectors)

    finished = reviews.select(F.col("id").alias("review_id"))
    write_children(done.issues, folder, "review_issues", finished)
    write_children(done.file_results, folder, "file_analysis_results", finished)
    rows = written(finish_reviews(reviews, done.reviews), "finished_reviews")
    completed = rows.where(F.col("status") == "completed")
    told = store_markdown(completed, repositories, done.file_results, done.issues)
    rows = written(told.unionByName(rows.where(F.col("status") != "completed")), "told_reviews")
    index = TextIndex(spark, f"{folder}/text_index")
    index.append(issue_texts(done.issues).unionByName(own_texts(rows)), finished)
    rows.write.mode("append").parquet(f"{folder}/reviews")
    return gated.join(reviews.select("repository_id", "user_id", F.col("id").alias("review_id")), ["repository_id", "user_id"], "left")
