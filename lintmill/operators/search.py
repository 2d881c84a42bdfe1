"""Review search: optional filters joined by AND, six orders, pages, totals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators.joins import first_per_key, position_within
from lintmill.operators.text_index import TextIndex
from lintmill.schemas import REVIEW_STATUSES, REVIEW_TYPES

# ---- fixed values: orders and bounds ----------------------------------------

SORTS = ["-created_at", "created_at", "-overall_score", "overall_score", "-issues_count", "issues_count"]
MAX_LIMIT = 100
MAX_QUERY_LENGTH = 200

HISTORY_COLUMNS = [
    "id",
    "repository_id",
    "repository_name",
    "review_type",
    "status",
    "overall_score",
    "issues_count",
    "files_analyzed",
    "summary",
    "ai_model",
    "created_at",
]


@dataclass(frozen=True)
class SearchParams:
    """What to look for.  Without ``user_id`` all users are searched at once."""

    user_id: str | None = None
    q: str | None = None
    repository_id: str | None = None
    review_type: str | None = None
    status: str | None = None
    severity: str | None = None
    min_score: float | None = None
    max_score: float | None = None
    from_date: datetime | None = None
    to_date: datetime | None = None
    sort: str = "-created_at"
    offset: int = 0
    limit: int = 20

    def __post_init__(self) -> None:
        def check(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"search parameter out of range: {what}")

        check(self.sort in SORTS, "sort")
        check(self.offset >= 0, "offset")
        check(1 <= self.limit <= MAX_LIMIT, "limit")
        check(self.min_score is None or self.min_score >= 0, "min_score")
        check(self.max_score is None or self.max_score >= 0, "max_score")
        check(self.q is None or len(self.q) <= MAX_QUERY_LENGTH, "q")
        check(self.review_type is None or self.review_type in REVIEW_TYPES, "review_type")
        check(self.status is None or self.status in REVIEW_STATUSES, "status")


def _like_pattern(q: str) -> str:
    """``%q%``; a backslash before an ordinary character stands for that character."""
    pattern, text = [], iter(f"%{q.strip()}%")
    for c in text:
        if c == "\\":
            c = next(text)
            pattern.append(f"\\{c}" if c in "%_\\" else c)
        else:
            pattern.append(c)
    return "".join(pattern)


def _any_like(columns: list[str], pattern: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns])


def search(
    reviews: DataFrame, repositories: DataFrame, issues: DataFrame, params: SearchParams, index: TextIndex | None = None
) -> DataFrame:
    """The matching reviews, unordered: user_id and the history columns.

    What is asked of a review's issues is decided per issue row first and brought
    down to one row per review inside each task; only review ids are shuffled.  With an
    ``index`` of all texts, a text is looked up there and neither issues nor reports are read.
    """
    p = params
    parents = reviews
    for column, value in [
        ("user_id", p.user_id),
        ("repository_id", p.repository_id),
        ("review_type", p.review_type),
        ("status", p.status),
    ]:
        if value is not None:
            parents = parents.where(F.col(column) == value)
    if p.min_score is not None:
        parents = parents.where(F.col("overall_score") >= p.min_score)
    if p.max_score is not None:
        parents = parents.where(F.col("overall_score") <= p.max_score)
    if p.from_date is not None:
        parents = parents.where(F.col("created_at") >= F.lit(p.from_date))
    if p.to_date is not None:
        parents = parents.where(F.col("created_at") <= F.lit(p.to_date))
    if parents is not reviews:
        # Only the issues of reviews that are still in question are matched.
        issues = issues.join(parents.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    if p.severity is not None:
        having = issues.where(F.col("severity") == p.severity).select(F.col("review_id").alias("id"))
        parents = parents.join(having.distinct(), "id", "left_semi")

    owners = repositories.select(F.col("id").alias("repository_id"), "owner", "name")
    found = parents.join(owners, "repository_id")
    if p.q:
        pattern = _like_pattern(p.q)
        matching = index.matching(pattern) if index is not None else None
        if matching is None:
            in_issue = issues.where(_any_like(["title", "explanation", "file_path"], pattern))
            matching = in_issue.select("review_id").distinct()
            in_review = _any_like(["summary", "report_markdown", "owner", "name"], pattern)
        else:
            in_review = _any_like(["owner", "name"], pattern)
        hits = matching.select(F.col("review_id").alias("id"), F.lit(True).alias("_hit"))
        found = found.join(hits, "id", "left").where(in_review | F.col("_hit").isNotNull())
    return found.withColumn("repository_name", F.concat("owner", F.lit("/"), "name")).select(
        "user_id", *HISTORY_COLUMNS
    )


def search_total(found: DataFrame) -> DataFrame:
    """Matches per user; ids are unique, so rows can be counted."""
    return found.groupBy("user_id").agg(F.count("*").alias("total"))


def _order(sort: str) -> list[Column]:
    column = sort.removeprefix("-")
    return [F.desc(column) if sort.startswith("-") else F.asc(column), F.asc("id")]


def search_page(found: DataFrame, params: SearchParams) -> DataFrame:
    """The asked page: of one user, in order; or of every user, with ``position``."""
    if params.user_id is not None:
        return found.orderBy(*_order(params.sort)).offset(params.offset).limit(params.limit)
    page = first_per_key(found, ["user_id"], _order(params.sort), params.offset + params.limit)
    return page.where(F.col("_rank") > params.offset).withColumnRenamed("_rank", "position")


def search_positions(found: DataFrame, sort: str) -> DataFrame:
    """All matches with their place in their user's result."""
    return position_within(found, ["user_id"], _order(sort))
