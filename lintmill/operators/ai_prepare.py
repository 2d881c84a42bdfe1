"""Batches for a language-model review: file choice, snippets, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions.text import line_count, path_key, with_lines
from lintmill.operators.joins import first_per_key
from lintmill.schemas import CATEGORIES, DEFAULT_SETTINGS, SEVERITIES
from lintmill.session import written

MAX_FILES = DEFAULT_SETTINGS["ai_max_files"]
MAX_CHARS = DEFAULT_SETTINGS["ai_max_chars_per_file"]

SYSTEM_PROMPT = (
    "Below are numbered source files of one repository. Find what a maintainer would want to "
    "fix: wrong behaviour, unsafe input handling, code that is hard to follow or to change, "
    "undocumented interfaces. Cite each finding by the path and the numbers in front of the "
    "lines; a finding that no shown line supports is an error. Your reply is read by a program."
)
ANSWER_FORMAT = (
    '{"summary": string, "issues": [{"file_path": string, "line_start": integer from 1, '
    '"line_end": integer or null, "category": ' + "|".join(CATEGORIES) + ", "
    '"severity": ' + "|".join(SEVERITIES) + ', "confidence": number from 0 to 1, '
    '"title": string, "explanation": string, "suggestion": string}]}'
)
TRUNCATED = "... (truncated)"


def top_files(files: DataFrame, n: int = MAX_FILES) -> DataFrame:
    """The first ``n`` files of each review in path order, with ``file_rank``."""
    keyed = files.withColumn("_path", path_key(F.col("file_path")))
    return first_per_key(keyed, ["review_id"], [F.asc("_path")], n).drop("_path").withColumnRenamed(
        "_rank", "file_rank"
    )


def reviews_without_files(reviews: DataFrame, chosen: DataFrame) -> DataFrame:
    """Reviews that fail because nothing can be sent."""
    ids = chosen.select(F.col("review_id").alias("id")).distinct()
    return reviews.join(ids, "id", "left_anti").select(
        F.col("id").alias("review_id"),
        F.lit("failed").alias("status"),
        F.lit("There are no source files to review").alias("error_message"),
    )


def _numbered(lines: Column, max_chars: int) -> Column:
    """Fold lines to ``%4d| text`` until one would pass the budget."""
    start = F.struct(
        F.lit("").alias("text"),
        F.lit(0).alias("used"),
        F.lit(0).alias("line_no"),
        F.lit(False).alias("full"),
    )

    def add(state: Column, line: Column) -> Column:
        entry = F.concat(F.format_string("%4d| ", state["line_no"] + 1), line)
        used = state["used"] + F.length(entry) + 1
        separator = F.when(state["line_no"] == 0, "").otherwise("\n")
        fits = used <= max_chars
        grown = F.struct(
            F.concat(state["text"], separator, F.when(fits, entry).otherwise(TRUNCATED)).alias("text"),
            used.cast("int").alias("used"),
            (state["line_no"] + 1).alias("line_no"),
            (~fits).alias("full"),
        )
        return F.when(state["full"], state).otherwise(grown)

    return F.aggregate(lines, start, add, lambda state: state["text"])


def chosen_texts(files: DataFrame, n: int = MAX_FILES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The chosen files: review_id, file_path, language, file_rank, line_count, head.

    Files are ranked by their paths alone; the few that are chosen, a small written table,
    then pick their rows from the corpus, and only these texts are counted and cut.

    A line costs its length plus seven at least, so what lies beyond the first
    ``max_chars`` characters can only fall under the truncation mark.  Cutting
    there keeps whole texts out of all that follows.
    """
    chosen = written(top_files(files.select("review_id", "file_path"), n), "chosen_files")
    picked = files.select("review_id", "file_path", "language", "content").join(chosen, ["review_id", "file_path"])
    content = F.col("content")
    return picked.select(
        "review_id",
        "file_path",
        F.coalesce("language", F.lit("unknown")).alias("language"),
        "file_rank",
        line_count(content).alias("line_count"),
        F.left(content, F.lit(max_chars + 1)).alias("head"),
    )


def snippets(files: DataFrame, n: int = MAX_FILES, max_chars: int = MAX_CHARS) -> DataFrame:
    """review_id, file_path, file_rank, snippet of the chosen files."""
    return numbered(chosen_texts(files, n, max_chars), max_chars)


def numbered(texts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The snippets of ``chosen_texts``."""
    return with_lines(texts, "head").select(
        "review_id", "file_path", "file_rank", _numbered(F.col("lines"), max_chars).alias("snippet")
    )


def prompts(snippet_rows: DataFrame, reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """review_id, system_prompt, user_prompt.  At most ``n`` bounded snippets each."""
    section = F.concat(
        F.lit("=== "), F.col("file_path"), F.lit(" ===\n"), F.col("snippet"), F.lit("\n")
    )
    sections = snippet_rows.groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct("file_rank", section.alias("text")))).alias("_sections")
    )
    named = reviews.select(F.col("id").alias("review_id"), "repository_id").join(
        repositories.select(
            F.col("id").alias("repository_id"), F.concat("owner", F.lit("/"), "name").alias("_repository")
        ),
        "repository_id",
    )
    body = F.array_join(F.transform("_sections", lambda s: s["text"]), "\n")
    return sections.join(named, "review_id").select(
        "review_id",
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(
            F.lit("Repository: "), F.col("_repository"), F.lit("\nShape of the reply, one JSON object:\n"),
            F.lit(ANSWER_FORMAT), F.lit("\n\nNumbered files:\n"), body,
            F.lit("\nReply with the object alone. Nothing found means an empty list of issues."),
        ).alias("user_prompt"),
    )
