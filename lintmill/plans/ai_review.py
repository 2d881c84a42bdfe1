"""The two halves of a language-model review; the model runs in between, elsewhere."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators import ai_ingest, ai_prepare
from lintmill.session import written


class Prepared(NamedTuple):
    prompts: DataFrame
    chosen: DataFrame
    without_files: DataFrame


class Ingested(NamedTuple):
    issues: DataFrame
    file_results: DataFrame
    reviews: DataFrame


def prepare(
    files: DataFrame,
    reviews: DataFrame,
    repositories: DataFrame,
    max_files: int = ai_prepare.MAX_FILES,
    max_chars: int = ai_prepare.MAX_CHARS,
) -> Prepared:
    """Prompts to send, the files behind them, and reviews with nothing to send."""
    texts = written(ai_prepare.chosen_texts(files, max_files, max_chars), "chosen_texts")
    chosen = texts.select("review_id", "file_path", "language", "line_count")
    return Prepared(
        ai_prepare.prompts(ai_prepare.numbered(texts, max_chars), reviews, repositories),
        chosen,
        ai_prepare.reviews_without_files(reviews, chosen),
    )


def ingest(
    answers: DataFrame, chosen: DataFrame, reviews: DataFrame, repositories: DataFrame, at: Column
) -> Ingested:
    """Answers (review_id, raw) to issues, file results and finished review rows.

    The parsed answers are written once, as three results are drawn from them.
    """
    parsed = written(ai_ingest.parse_answers(answers), "answers")
    issues = ai_ingest.ai_issues(parsed)
    results = ai_ingest.ai_file_scores(chosen, parsed, issues)
    summaries = ai_ingest.ai_review_summaries(parsed, results, issues, reviews, repositories)
    models = reviews.select(F.col("id").alias("review_id"), "ai_model")
    rows = (
        summaries.join(models, "review_id")
        .withColumn("completed_at", at)
        .withColumn("report_markdown", F.lit(None).cast("string"))
    )
    return Ingested(issues, results, rows)
