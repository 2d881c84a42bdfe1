"""Static review of all files of all repositories, in one job."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators.duplicates import repeated_blocks
from lintmill.operators.line_rules import broken_rules
from lintmill.operators.long_functions import overlong_functions, spans_of
from lintmill.operators.python_facts import python_facts
from lintmill.operators.python_rules import parser_failures, python_issues
from lintmill.operators.scoring import file_results, review_summaries
from lintmill.operators.text_scan import blocks, braces, counted_lines, large_files, lines_with_hits, scan_texts
from lintmill.session import setting, written


def _small_methods(df: DataFrame) -> AbstractContextManager[None]:
    """All rules in one generated method are more than the JVM compiles; beyond this many
    bytes Spark generates small ones instead, four times as fast here."""
    return setting(df.sparkSession, "spark.sql.codegen.hugeMethodLimit", "8000")


class StaticReview(NamedTuple):
    issues: DataFrame
    file_results: DataFrame
    reviews: DataFrame


class Scanned:
    """A corpus as detectors see it: its files, and what one pass over the texts says of them.

    Texts are split once and Python is parsed once, when a detector first asks, and written;
    everything after works on these tables. Of a block within a file two places are enough: an
    issue names the first two of the review.
    """

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def texts(self) -> DataFrame:
        """One row for each line that carries something; see ``text_scan``."""
        with _small_methods(self.files):
            return written(scan_texts(self.files, places=2), "texts")

    @cached_property
    def facts(self) -> DataFrame:
        return written(python_facts(self.files), "python_facts")


Detector = Callable[[Scanned], DataFrame]

# Detectors by name: a transform from a scanned corpus to issue rows.  Each looks only at the
# languages it knows; one may be added or taken away in a copy of this table.
DETECTORS: dict[str, Detector] = {
    "lines": lambda scanned: broken_rules(lines_with_hits(scanned.texts)),
    "large_files": lambda scanned: large_files(scanned.texts),
    "brace_functions": lambda scanned: overlong_functions(spans_of(braces(scanned.texts))),
    "python": lambda scanned: python_issues(scanned.facts),
    "duplicates": lambda scanned: repeated_blocks(blocks(scanned.texts)),
}


def all_issues(files: DataFrame | Scanned, detectors: dict[str, Detector] = DETECTORS) -> DataFrame:
    """What all detectors find, as one bag of issue rows."""
    scanned = files if isinstance(files, Scanned) else Scanned(files)
    return reduce(DataFrame.unionByName, [detect(scanned) for detect in detectors.values()])


def scored_files(scanned: Scanned, issues: DataFrame) -> DataFrame:
    """One row per file with its issues and score."""
    return file_results(counted_lines(scanned.texts), issues)


def run_static_review(
    files: DataFrame, reviews: DataFrame, repositories: DataFrame, at: Column, detectors: dict[str, Detector] = DETECTORS
) -> StaticReview:
    """Issues, file results and finished review rows for ``files``."""
    scanned = Scanned(files)
    facts = scanned.facts
    with _small_methods(files):
        issues = written(all_issues(scanned, detectors), "issues")
    failures = parser_failures(facts)
    results = scored_files(scanned, issues)
    done = review_summaries(results, issues, reviews, repositories)
    finished = done.join(failures.select("review_id", F.lit(True).alias("_failed")), "review_id", "left")
    failed = F.col("_failed").isNotNull()

    def unless_failed(column: str, otherwise: object = None) -> Column:
        return F.when(~failed, F.col(column)).otherwise(F.lit(otherwise)).alias(column)

    rows = finished.select(
        "review_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        unless_failed("files_analyzed", 0),
        unless_failed("issues_count", 0),
        unless_failed("overall_score", 0.0),
        unless_failed("summary"),
        F.when(failed, "A file could not be parsed").alias("error_message"),
        at.alias("completed_at"),
        F.lit(None).cast("string").alias("ai_model"),
        F.lit(None).cast("string").alias("report_markdown"),
    )
    kept = failures.select("review_id")
    return StaticReview(
        issues.join(kept, "review_id", "left_anti"),
        results.join(kept, "review_id", "left_anti"),
        rows,
    )
