"""Answers of a language model: parsing, validation, normalisation.

An answer is one row and is judged inside that row, so nothing is shuffled until
issues are counted per file.  One bad field rejects the whole answer; a rejected
answer fails its review, never the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions.text import strip
from lintmill.operators.scoring import file_results, review_scores
from lintmill.schemas import CATEGORIES, ISSUE_COLUMNS, SEVERITIES

INVALID_ANSWER = "The model's answer is not valid review JSON"

# What an unknown word becomes, and the longest title.
DEFAULT_CATEGORY = "code_smell"
DEFAULT_SEVERITY = "medium"
MAX_TITLE = 255
_NUMBER_FIELDS = ["line_start", "line_end", "confidence"]
_TEXT_FIELDS = ["file_path", "category", "severity", "title", "explanation", "suggestion"]


def parse_json(raw: Column) -> Column:
    """JSON text to VARIANT, null unless the whole text is one JSON value.

    ``try_parse_json`` stops after the first value and accepts what follows.  So
    the text is put into an array before a seal that it cannot contain, its own
    hash, and the array must consist of just these two.
    """
    seal = F.sha2(raw, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), seal, F.lit('"]')))
    last = F.try_variant_get(wrapped, "$[1]", "string")
    third = F.try_variant_get(wrapped, "$[2]", "variant")
    return F.when((last == seal) & third.isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _type(v: Column) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, ARRAY.., OBJECT..; SQL null
    for a missing field."""
    return F.schema_of_variant(v)


def _scalar(fields: Column, name: str) -> Column:
    """Type, text and number of a field, for the checks below to choose from."""
    field = fields[name]
    return F.struct(
        _type(field).alias("type"),
        F.try_variant_get(field, "$", "string").alias("text"),
        F.try_variant_get(field, "$", "double").alias("number"),
    ).alias(name)


def _read_issue(fields: Column) -> Column:
    """The fields of one list entry as they come.

    They come as a map: a look-up in a VARIANT spells out the names it passes, each time.
    """
    return F.struct(
        *[_scalar(fields, f) for f in _NUMBER_FIELDS],
        *[F.when(_type(fields[f]) == "STRING", F.try_variant_get(fields[f], "$", "string")).alias(f) for f in _TEXT_FIELDS],
    )


def _number(s: Column) -> Column:
    """The value where a lax validator takes it for a number, else null: numbers,
    numeric strings and booleans pass."""
    text = strip(s["text"])
    numeric = text.rlike(r"^[+-]?(\d+(_\d+)*)?\.?\d*([eE][+-]?\d+)?\z") & text.rlike(r"\d")
    from_text = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    return (
        F.when(s["type"].rlike("^(BIGINT|DECIMAL|DOUBLE)"), s["number"])
        .when(s["type"] == "BOOLEAN", F.when(s["text"] == "true", 1.0).otherwise(0.0))
        .when((s["type"] == "STRING") & numeric, from_text)
    )


def _whole(s: Column) -> Column:
    """The value as a whole number, or null: 3, 3.0 and "3" pass, 3.5 and "3e0" do not."""
    plain = (s["type"] != "STRING") | strip(s["text"]).rlike(r"^[+-]?\d+(_\d+)*(\.0*)?\z")
    value = F.when(plain, _number(s))
    return F.when(value % 1 == 0, value.try_cast("int"))


def _numbers(r: Column) -> Column:
    return F.struct(
        _whole(r["line_start"]).alias("line_start"),
        _whole(r["line_end"]).alias("line_end"),
        F.coalesce(r["line_end"]["type"] == "VOID", F.lit(True)).alias("no_end"),
        _number(r["confidence"]).alias("confidence"),
        *[r[f].alias(f) for f in _TEXT_FIELDS],
    )


def _checked(n: Column) -> Column:
    checks = [n["line_start"] >= 1, n["confidence"].between(0.0, 1.0)]
    checks += [n[f].isNotNull() for f in _TEXT_FIELDS]
    checks.append(n["no_end"] | n["line_end"].isNotNull())
    valid = F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))
    fields = ["line_start", "line_end", "confidence", *_TEXT_FIELDS]
    return F.struct(valid.alias("valid"), *[n[f].alias(f) for f in fields])


def parse_answers(answers: DataFrame) -> DataFrame:
    """review_id, status, error_message, summary, issues (array of structs).

    Each step binds what the next one names more than once: inside one expression
    a value named twice would be computed, and planned, twice.
    """
    parsed = answers.select("review_id", parse_json(F.col("raw")).alias("_v"))
    read = parsed.select(
        "review_id",
        # Only an object has fields; a list of anything but objects and nulls is none.
        _type(_field(F.col("_v"), "summary")).alias("_summary_type"),
        F.try_variant_get(F.col("_v"), "$.summary", "string").alias("summary"),
        _field(F.col("_v"), "issues").isNull().alias("_no_issues"),
        F.try_variant_get(F.col("_v"), "$.issues", "array<map<string, variant>>").alias("_listed"),
    )
    listed = F.coalesce("_listed", F.array().cast("array<map<string, variant>>"))
    checked = read.withColumn("_read", F.transform(listed, _read_issue)).withColumn("_issues", F.transform(F.transform("_read", _numbers), _checked))
    # A missing list is an empty one; null or anything else is an error.
    valid = (
        F.coalesce(F.col("_summary_type") == "STRING", F.lit(False))
        & (F.col("_no_issues") | F.col("_listed").isNotNull())
        & F.forall("_issues", lambda i: i["valid"])
    )
    return checked.withColumn("_valid", valid).select(
        "review_id",
        F.when(F.col("_valid"), "completed").otherwise("failed").alias("status"),
        F.when(~F.col("_valid"), INVALID_ANSWER).alias("error_message"),
        F.when(F.col("_valid"), F.col("summary")).alias("summary"),
        F.when(F.col("_valid"), F.col("_issues")).alias("issues"),
    )


def _known(word: Column, words: list[str], default: str) -> Column:
    lowered = F.lower(word)
    return F.when(lowered.isin(words), lowered).otherwise(default)


def ai_issues(parsed: DataFrame) -> DataFrame:
    """Issue rows of the valid answers."""
    items = parsed.select("review_id", F.posexplode("issues").alias("_pos", "_i"))
    category = _known(F.col("_i.category"), CATEGORIES, DEFAULT_CATEGORY)
    return items.select(
        "review_id",
        "_i.file_path",
        "_i.line_start",
        "_i.line_end",
        category.alias("category"),
        _known(F.col("_i.severity"), SEVERITIES, DEFAULT_SEVERITY).alias("severity"),
        "_i.confidence",
        F.concat(F.lit("ai:"), category, F.lit(":"), F.col("_pos") + 1).alias("rule_id"),
        F.left(F.col("_i.title"), F.lit(MAX_TITLE)).alias("title"),
        "_i.explanation",
        "_i.suggestion",
    ).select(*ISSUE_COLUMNS)


def ai_file_scores(chosen: DataFrame, parsed: DataFrame, issues: DataFrame) -> DataFrame:
    """Scores of the files that were sent (review_id, file_path, language, line_count)
    in reviews with a valid answer.  Issues that name another path score nothing."""
    done = parsed.where(F.col("status") == "completed").select("review_id")
    return file_results(chosen.join(done, "review_id", "left_semi"), issues)


def ai_review_summaries(
    parsed: DataFrame, results: DataFrame, issues: DataFrame, reviews: DataFrame, repositories: DataFrame
) -> DataFrame:
    """Counters, score, status and summary; a blank summary gets a generated one."""
    n_issues = issues.groupBy("review_id").agg(F.count("*").alias("_issues"))
    owners = reviews.select(F.col("id").alias("review_id"), "repository_id").join(
        repositories.select(
            F.col("id").alias("repository_id"), F.concat("owner", F.lit("/"), "name").alias("_repository")
        ),
        "repository_id",
    )
    joined = (
        parsed.select("review_id", "status", "error_message", "summary")
        .join(owners, "review_id")
        .join(review_scores(results), "review_id", "left")
        .join(n_issues, "review_id", "left")
    )
    done = F.col("status") == "completed"
    files, found = F.coalesce("files_analyzed", F.lit(0)), F.coalesce("_issues", F.lit(0))
    score = F.coalesce("overall_score", F.lit(100.0))
    generated = F.concat(
        F.lit("AI review of "), files, F.lit(" files in "), F.col("_repository"), F.lit(". Found "),
        found, F.lit(" issues with an overall score of "), score, F.lit("."),
    )
    return joined.select(
        "review_id",
        "status",
        "error_message",
        F.when(done, files).otherwise(0).cast("int").alias("files_analyzed"),
        F.when(done, found).otherwise(0).cast("int").alias("issues_count"),
        F.when(done, score).otherwise(0.0).alias("overall_score"),
        F.when(done, F.coalesce(F.nullif(strip(F.col("summary")), F.lit("")), generated)).alias("summary"),
    )
