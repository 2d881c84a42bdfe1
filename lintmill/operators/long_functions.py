"""Functions of more than 50 lines in brace languages, by counting braces.

Where does the function that starts in line s end?  With ``depth(L)`` the
running difference of opening and closing braces, it ends at the first line at
or after the first opening brace whose depth is not above the depth before s.
Joining every start with every later line would square the size of a file.
Instead each line states which depths it falls through, and each start looks up
the nearest later line that falls through its own depth.  The rows are as many
as there are braces, and both look-ups are running aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.functions.text import line_count, unicode_pattern, with_lines
from lintmill.operators.rule_catalog import FUNCTION_START, MAX_FUNCTION_LINES
from lintmill.schemas import ISSUE_COLUMNS

BRACE_FUNCTION_LANGUAGES = ["javascript", "typescript"]
# A line without any of these has no brace and starts no function.
BRACE_NEEDLES = ("{", "}", "function", "=>")


def brace_columns(line: Column) -> list[Column]:
    """opened, closed and the name of a function that starts in the line; null where there is none of them."""
    pattern = unicode_pattern(FUNCTION_START)
    may_start = (
        F.contains(line, F.lit("function"))
        | F.contains(line, F.lit("=>"))
        | F.contains(line, F.lit("{"))
    )
    starts = may_start & line.rlike(pattern)
    some = F.contains(line, F.lit("{")) | F.contains(line, F.lit("}")) | starts

    def count(brace: str) -> Column:
        return F.when(some, F.octet_length(line) - F.octet_length(F.replace(line, F.lit(brace), F.lit(""))))

    name = F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in (1, 2, 3)])
    return [count("{").alias("opened"), count("}").alias("closed"), F.when(starts, name).alias("name")]


def function_spans(files: DataFrame, min_lines: int = 1) -> DataFrame:
    """review_id, file_path, name, line_start, line_end of all functions in brace
    files of at least ``min_lines`` lines."""
    texts = files.where(F.col("language").isin(BRACE_FUNCTION_LANGUAGES))
    # Counting line ends is cheap; a filter on the split lines would be pushed down
    # and split every text again.
    content = F.col("content")
    large = texts.where(F.octet_length(content) >= min_lines - 1).where(line_count(content) >= min_lines)
    counted = with_lines(large.select("review_id", "file_path", "content")).select(
        "review_id", "file_path", "lines", F.size("lines").alias("n_lines")
    )
    exploded = counted.select(
        "review_id", "file_path", "n_lines", F.posexplode_outer("lines").alias("_pos", "line")
    )
    marked = exploded.select(
        "review_id", "file_path", "n_lines", (F.col("_pos") + 1).alias("line_no"), *brace_columns(F.col("line"))
    )
    return spans_of(marked.where(F.col("opened").isNotNull()))


def spans_of(braces: DataFrame) -> DataFrame:
    """The spans, from the lines with braces or starts: review_id, file_path, n_lines,
    line_no, opened, closed, name (see ``brace_columns``)."""
    marked = braces.select(
        "review_id",
        "file_path",
        F.col("n_lines").alias("_n_lines"),
        F.col("line_no").alias("_line"),
        F.col("opened").alias("_open"),
        F.col("closed").alias("_close"),
        F.col("name").alias("_name"),
    )

    # Read from the last line up: a frame that grows is cheap, one that shrinks
    # is recomputed for each row.  ``_rest`` is the brace balance from here on,
    # so the depth after a line is the file's total less the rest below it.
    upward = Window.partitionBy("review_id", "file_path").orderBy(F.desc("_line"))
    running = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    balance = F.col("_open") - F.col("_close")
    opened = F.col("_open") > 0
    rest = marked.withColumn("_rest", F.sum(balance).over(running)).withColumn(
        "_below", F.col("_rest") - balance
    )
    rest = rest.withColumn(
        "_first_open", F.min(F.when(opened, F.col("_line"))).over(running)
    ).withColumn(
        "_below_open", F.last(F.when(opened, F.col("_below")), ignorenulls=True).over(running)
    )

    # The line falls through every level in (_rest, _below]; a start waits at
    # level _rest for the nearest such line after its first opening brace.
    falls = F.when(
        F.col("_below") > F.col("_rest"),
        F.transform(
            F.sequence(F.col("_rest") + 1, F.col("_below")),
            lambda level: F.struct(
                level.alias("level"),
                F.col("_line").alias("at"),
                F.lit(0).alias("is_start"),
            ),
        ),
    ).otherwise(F.array())
    waits = F.when(
        F.col("_name").isNotNull()
        & F.col("_first_open").isNotNull()
        & (F.col("_below_open") < F.col("_rest")),
        F.array(
            F.struct(
                F.col("_rest").alias("level"),
                F.col("_first_open").alias("at"),
                F.lit(1).alias("is_start"),
            )
        ),
    ).when(
        # Ends where it opens, or never opens: settled without a look-up.
        F.col("_name").isNotNull(),
        F.array(
            F.struct(
                F.lit(None).cast("long").alias("level"),
                F.col("_first_open").alias("at"),
                F.lit(1).alias("is_start"),
            )
        ),
    ).otherwise(F.array())
    events = rest.select(
        "review_id",
        "file_path",
        "_n_lines",
        "_line",
        "_name",
        F.explode_outer(F.concat(falls, waits)).alias("_e"),
    ).where(F.col("_e").isNotNull()).select("review_id", "file_path", "_n_lines", "_line", "_name", "_e.*")

    # At one line the start comes first here, so that a line does not end a
    # function it opens after the braces were counted.
    nearest = (
        Window.partitionBy("review_id", "file_path", "level")
        .orderBy(F.desc("at"), F.desc("is_start"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ended = events.withColumn(
        "_end", F.min(F.when(F.col("is_start") == 0, F.col("at"))).over(nearest)
    ).where(F.col("is_start") == 1)
    settled = F.when(F.col("level").isNull(), F.col("at")).otherwise(F.col("_end"))
    return ended.select(
        "review_id",
        "file_path",
        F.col("_name").alias("name"),
        F.col("_line").alias("line_start"),
        F.coalesce(settled, F.col("_n_lines")).alias("line_end"),
    )


def long_function_issues(files: DataFrame) -> DataFrame:
    return overlong_functions(function_spans(files, MAX_FUNCTION_LINES + 1))


def overlong_functions(spans: DataFrame) -> DataFrame:
    spans = spans.withColumn("_length", F.col("line_end") - F.col("line_start") + 1)
    return spans.where(F.col("_length") > MAX_FUNCTION_LINES).select(
        "review_id",
        "file_path",
        "line_start",
        "line_end",
        F.lit("long_method").alias("category"),
        F.lit("medium").alias("severity"),
        F.lit(0.7).alias("confidence"),
        F.lit("long-function-heuristic").alias("rule_id"),
        F.concat(F.lit("Function '"), F.col("name"), F.lit("' seems too long")).alias("title"),
        F.concat(F.lit("It runs over about "), F.col("_length"), F.lit(" lines.")).alias("explanation"),
        F.lit("Divide it into smaller functions.").alias("suggestion"),
    ).select(*ISSUE_COLUMNS)
