"""Line and file rules: one narrow pass over the files, no shuffle.

A file row becomes line rows, each line gets the set of rules it breaks as the
bits of one long, lines without a bit are dropped inside generated code, and
only the few remaining ones are expanded to issue rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions.text import BLANK, explode_lines, line_count, unicode_pattern
from lintmill.operators.rule_catalog import (
    COMMON_RULES,
    LANGUAGE_RULES,
    LONG_LINE,
    MAX_FILE_LINES,
    MAX_LINE_LENGTH,
    LineRule,
)
from lintmill.schemas import ISSUE_COLUMNS

_ALL_RULES = list(
    dict.fromkeys([LONG_LINE, *COMMON_RULES, *(r for rs in LANGUAGE_RULES.values() for r in rs)])
)


def _breaks(rule: LineRule, line: Column) -> Column:
    if rule is LONG_LINE:
        # Bytes first: they need no scan, and are never fewer than characters.
        return (F.octet_length(line) > MAX_LINE_LENGTH) & (F.length(line) > MAX_LINE_LENGTH)
    near = reduce(lambda a, b: a | b, [F.contains(line, F.lit(n)) for n in rule.needles])
    return near & line.rlike(unicode_pattern(rule.pattern))


def _counts(line: Column) -> Column:
    """Common rules pass over blank lines and lines that start with ``#``."""
    return ~line.rlike(f"(?U)^{BLANK}*(?:#|\\z)")


def _bits(rules: list[LineRule], line: Column, guard: Column | None = None) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rules:
        hit = _breaks(rule, line)
        if guard is not None:
            hit = hit & guard
        bit = 1 << _ALL_RULES.index(rule)
        bits = bits.bitwiseOR(F.when(hit, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _rule_mask(language: Column, line: Column, only: set[str] | None) -> Column:
    def wanted(rules: list[LineRule]) -> list[LineRule]:
        return [r for r in rules if only is None or r.rule_id in only]

    mask = _bits(wanted([LONG_LINE, *COMMON_RULES]), line, _counts(line))
    by_rules: dict[tuple, list[str]] = {}
    for name, rules in LANGUAGE_RULES.items():
        by_rules.setdefault(tuple(wanted(rules)), []).append(name)
    specific = F.lit(0).cast("long")
    for rules, names in by_rules.items():
        if rules:
            specific = F.when(language.isin(names), _bits(list(rules), line)).otherwise(specific)
    return mask.bitwiseOR(specific)


def rule_bits(language: Column, line: Column) -> Column:
    """The rules a line breaks, as bits; none in a file of no known language."""
    known = language.isin(list(LANGUAGE_RULES))
    return F.when(known, _rule_mask(language, line, None)).otherwise(F.lit(0).cast("long"))


def line_issues(files: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Issues of the common and language line rules (or of those in ``only``)."""
    known = files.where(F.col("language").isin(list(LANGUAGE_RULES)))
    lines = explode_lines(known, "review_id", "file_path", "language")
    hits = lines.withColumn("bits", _rule_mask(F.col("language"), F.col("line"), only)).where(
        F.col("bits") != 0
    )
    return broken_rules(hits.withColumn("n_chars", F.length("line")))


def broken_rules(hits: DataFrame) -> DataFrame:
    """Issue rows of lines (review_id, file_path, line_no, n_chars) with ``bits`` set."""
    broken = F.filter(
        F.sequence(F.lit(0), F.lit(len(_ALL_RULES) - 1)),
        lambda i: F.getbit(F.col("bits"), i) == 1,
    )
    details = F.array(
        *[
            F.struct(
                F.lit(r.category).alias("category"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.confidence).alias("confidence"),
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.title).alias("title"),
                F.lit(r.explanation).alias("explanation"),
                F.lit(r.suggestion).alias("suggestion"),
            )
            for r in _ALL_RULES
        ]
    )
    found = hits.select("review_id", "file_path", "line_no", "n_chars", F.explode_outer(broken).alias("_no"))
    issue = found.withColumn("_rule", F.get(details, F.col("_no")))
    explanation = F.when(
        F.col("_rule.rule_id") == LONG_LINE.rule_id,
        F.concat(
            F.lit("The line has "), F.col("n_chars"), F.lit(f" characters, more than {MAX_LINE_LENGTH}.")
        ),
    ).otherwise(F.col("_rule.explanation"))
    return issue.select(
        "review_id",
        "file_path",
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
        "_rule.category",
        "_rule.severity",
        "_rule.confidence",
        "_rule.rule_id",
        "_rule.title",
        explanation.alias("explanation"),
        "_rule.suggestion",
    ).select(*ISSUE_COLUMNS)


def large_file_issues(files: DataFrame) -> DataFrame:
    """One issue for each file of more than 500 lines, blank ones included."""
    known = files.where(F.col("language").isin(list(LANGUAGE_RULES)))
    # A text of so many lines has at least as many bytes less one.
    long_enough = known.where(F.octet_length("content") >= MAX_FILE_LINES)
    counted = long_enough.select("review_id", "file_path", line_count(F.col("content")).alias("n_lines"))
    return overlong_files(counted)


def overlong_files(counted: DataFrame) -> DataFrame:
    """Issue rows of files (review_id, file_path, n_lines) with too many lines."""
    return counted.where(F.col("n_lines") > MAX_FILE_LINES).select(
        "review_id",
        "file_path",
        F.lit(1).alias("line_start"),
        F.col("n_lines").alias("line_end"),
        F.lit("complexity").alias("category"),
        F.lit("medium").alias("severity"),
        F.lit(0.8).alias("confidence"),
        F.lit("large-file").alias("rule_id"),
        F.lit("Very large file").alias("title"),
        F.concat(F.lit("The file has "), F.col("n_lines"), F.lit(" lines.")).alias("explanation"),
        F.lit("Divide it into smaller modules.").alias("suggestion"),
    )
