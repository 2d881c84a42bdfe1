"""Text and path expressions with the semantics of a Python source scanner."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.schemas import LANGUAGE_BY_EXTENSION

# What ends a line, and what counts as blank or as a word character.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
RARE_LINE_ENDS = ["\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
WHITE_SPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = "[\\s\\x1C-\\x1F]"
WORD = "[\\p{L}\\p{N}_]"

_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def unicode_pattern(pattern: str) -> str:
    r"""Spell ``\b``, ``\w`` and ``\s`` out, so that they mean the same on every JDK."""
    return "(?U)" + (
        pattern.replace(r"\b", _BOUNDARY).replace(r"\w", WORD).replace(r"\s", BLANK)
    )


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` removes only blanks)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def decode(raw: Column) -> Column:
    """Bytes to text: UTF-8 with replacement characters, line ends as ``\\n``."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(
        text
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _has_rare_line_end(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(e)) for e in RARE_LINE_ENDS])


def with_lines(df: DataFrame, content: str = "content", into: str = "lines") -> DataFrame:
    """Add the array of lines; a final line end opens no further line.

    Byte searches for the rare line ends keep the regular expression away from
    texts that have none of them, where splitting at ``\\n`` is far faster.
    """
    text = F.col(content)
    parts = F.when(_has_rare_line_end(text), F.split(text, LINE_END, -1)).otherwise(
        F.split(text, "\n", -1)
    )
    last_is_empty = F.element_at(F.col(into), -1) == ""
    kept = F.size(into) - F.when(last_is_empty, 1).otherwise(0)
    return df.withColumn(into, parts).withColumn(into, F.slice(F.col(into), F.lit(1), kept))


def line_count(text: Column) -> Column:
    """Number of lines, counted from the line ends without cutting the text up."""

    def count(t: Column) -> Column:
        ends = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
        rest = F.when((t == "") | F.endswith(t, F.lit("\n")), 0).otherwise(1)
        rare_ends = F.regexp_count(t, F.lit(LINE_END))
        rare_rest = F.when((t == "") | t.rlike(f"(?:{LINE_END})\\z"), 0).otherwise(1)
        return F.when(_has_rare_line_end(t), rare_ends + rare_rest).otherwise(ends + rest)

    return let(text, count)


def explode_lines(df: DataFrame, *keep: str) -> DataFrame:
    """One row per line: ``keep`` columns, 1-based ``line_no``, ``line``.

    The outer form spares a filter on the array, which would split the text a
    second time.
    """
    lines = with_lines(df).select(*keep, F.posexplode_outer("lines").alias("_pos", "line"))
    return lines.where(F.col("line").isNotNull()).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    )


def path_key(path: Column) -> Column:
    """A string that sorts as the list of the path's parts does.

    The separator becomes the lowest character, so ``a/b.py`` sorts before
    ``a.py``.  One string compares faster than an array of parts.
    """
    return F.replace(path, F.lit("/"), F.lit("\0"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension, lower-cased; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def language_of(path: Column) -> Column:
    """Language by extension; null when the extension is not a known one."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(known, suffix(path))


def csv_list(c: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with offset; the fraction only when there is one."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    fraction = F.when(
        F.date_format(utc, "SSSSSS") != "000000", F.date_format(utc, ".SSSSSS")
    ).otherwise("")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
