"""Repeated blocks of four lines within one review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.functions.text import path_key, strip, with_lines
from lintmill.operators.rule_catalog import BLOCK_LINES
from lintmill.schemas import ISSUE_COLUMNS
from lintmill.session import written

#: Words of 64 bits that mark repeated blocks: 32 MB to broadcast, whatever the corpus.
SLOTS = 1 << 21


def neighbours(lines: Column, size: int = BLOCK_LINES) -> Column:
    """Each line with the ``size`` - 1 after it, as structs of l0, l1, ...; null beyond the end.

    A row made of these carries a few lines on. It must not carry the array: Spark would copy
    the whole text for each of its lines.
    """
    return F.arrays_zip(*[F.slice(lines, F.lit(k + 1), F.greatest(F.size(lines) - k, F.lit(0))).alias(f"l{k}") for k in range(size)])


def block_columns(lines: list[Column]) -> tuple[Column, Column]:
    """Whether there are all these lines and they hold more than comments, and the SHA-256 of
    them, stripped (32 bytes)."""
    block = [strip(line) for line in lines]

    def is_code(line: Column) -> Column:
        return (line != "") & ~line.startswith("//") & ~line.startswith("#")

    has_code = reduce(lambda a, b: a | b, [is_code(line) for line in block])
    return lines[-1].isNotNull() & has_code, F.unhex(F.sha2(F.concat_ws("\n", *block), 256))


def shingles(files: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """Every window of ``size`` stripped lines that holds more than comments.

    Columns: review_id, file_path, line_start, fingerprint (SHA-256, 32 bytes).
    The windows are cut inside the file's own row, so nothing is shuffled, and
    the texts end here: only the fingerprint travels on.
    """
    lines = with_lines(files.select("review_id", "file_path", "content"))
    # The outer form of explode, here and elsewhere, keeps the optimizer from putting
    # a filter on the array, and with it a second split, below.  An empty file gives one
    # null line, which is no code.
    windows = lines.select(
        "review_id", "file_path", F.posexplode_outer(neighbours(F.col("lines"), size)).alias("_pos", "_block")
    )
    has_code, fingerprint = block_columns([F.col(f"_block.l{k}") for k in range(size)])
    return windows.where(has_code).select(
        "review_id", "file_path", (F.col("_pos") + 1).alias("line_start"), fingerprint.alias("fingerprint")
    )


def _of_repeated(blocks: DataFrame) -> DataFrame:
    """The blocks that may stand at several places of their review; most others are left out.

    Of all blocks only an eight-byte mark is shuffled, and counted. The marks that occur twice or
    more set one bit each among SLOTS words, whatever their number, so the words can be
    broadcast. A bit that another mark has set lets a single block pass; none is lost.
    """
    mark = F.xxhash64("review_id", "fingerprint")
    slot, bit = F.pmod(F.col("_mark"), F.lit(SLOTS)), F.shiftrightunsigned("_mark", 58).cast("int")
    repeated = blocks.select(mark.alias("_mark")).groupBy("_mark").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    word = F.lit(1).cast("long")
    words = repeated.groupBy(slot.alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", word, bit)).alias("_word"))
    marked = blocks.withColumn("_mark", mark).withColumn("_slot", slot)
    met = marked.join(F.broadcast(words), "_slot")  # SLOTS rows at most
    return met.where(F.getbit("_word", bit) == 1).select(*blocks.columns)


def duplicate_issues(files: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """One issue per repeated block, placed at its first occurrence."""
    return repeated_blocks(written(shingles(files, size), "blocks"), size)


def repeated_blocks(blocks: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """The issues, from all blocks (review_id, file_path, line_start, fingerprint), a written table.

    Only the first two places of a block matter.  The rank filter lets Spark cut
    every block to two places per task before the shuffle, so a licence header
    in a third of all files costs no more than a rare block.
    """
    places = _of_repeated(blocks).select(
        "review_id", "fingerprint", path_key(F.col("file_path")).alias("_path"), "line_start"
    )
    by_block = Window.partitionBy("review_id", "fingerprint").orderBy("_path", "line_start")
    ranked = places.withColumn("_rank", F.row_number().over(by_block)).where(F.col("_rank") <= 2)
    pairs = ranked.groupBy("review_id", "fingerprint").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("_path"))).alias("_path"),
        F.max(F.when(F.col("_rank") == 1, F.col("line_start"))).alias("line_start"),
        F.max(F.when(F.col("_rank") == 2, F.col("_path"))).alias("_other"),
        F.max(F.when(F.col("_rank") == 2, F.col("line_start"))).alias("_other_line"),
    )

    def as_path(key: Column) -> Column:
        return F.replace(key, F.lit("\0"), F.lit("/"))

    return pairs.where(F.col("_other").isNotNull()).select(
        "review_id",
        as_path(F.col("_path")).alias("file_path"),
        "line_start",
        (F.col("line_start") + (size - 1)).alias("line_end"),
        F.lit("duplicated_code").alias("category"),
        F.lit("medium").alias("severity"),
        F.lit(0.75).alias("confidence"),
        F.lit("duplicated-block").alias("rule_id"),
        F.lit("Duplicated code block").alias("title"),
        F.concat(
            F.lit(f"The same {size} lines stand in "),
            as_path(F.col("_other")),
            F.lit(" from line "),
            F.col("_other_line"),
            F.lit("."),
        ).alias("explanation"),
        F.lit("Move the shared lines to one function or module.").alias("suggestion"),
    ).select(*ISSUE_COLUMNS)
