"""Everything the static rules ask of a text, in one pass over it.

A text is cut up once, where it is read, and a line becomes a narrow row that carries
what any rule may want: the rules it breaks as bits, its braces, the fingerprint of the
block it opens. Lines that hold none of what some rule looks for go without their text,
and the rules are asked of the others only. The texts end here. What follows reads the
columns it needs of the written rows, and Parquet skips the others.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions.text import WHITE_SPACE
from lintmill.operators.line_rules import overlong_files, rule_bits
from lintmill.operators.long_functions import BRACE_FUNCTION_LANGUAGES, BRACE_NEEDLES, brace_columns
from lintmill.operators.rule_catalog import BLOCK_LINES, COMMON_RULES, LANGUAGE_RULES, MAX_FUNCTION_LINES, MAX_LINE_LENGTH

BATCH_ROWS = 20_000
#: Bytes of text cut at once; a longer text is cut by itself.
GROUP_BYTES = 1 << 19
_COMMENTS = ("//", "#")
_MOST = 1 << 62


def _pattern(needles: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, dict.fromkeys(needles)))


# What a line must hold to break a rule of the language, besides being long.
_NEEDLES = {name: _pattern(tuple(n for r in [*COMMON_RULES, *rules] for n in r.needles)) for name, rules in LANGUAGE_RULES.items()}

_CUT = pa.schema(
    [(c, pa.string()) for c in ("review_id", "file_path", "language")]
    + [("n_lines", pa.int32()), ("line_no", pa.int32()), ("line", pa.string()), ("fingerprint", pa.binary())]
)
CUT_SCHEMA = "review_id string, file_path string, language string, n_lines int, line_no int, line string, fingerprint binary"


class _Lines(NamedTuple):
    """The lines of several texts, one after the other."""

    first: np.ndarray  # of each text the number of its first line, and behind the last text that of all lines
    owner: np.ndarray  # of each line its text
    raw: pa.StringArray  # with their line ends; the last line of a text may have none
    n_bytes: np.ndarray  # without them


def _rare_ends(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a line end other than ``\\n``."""
    rare = ((data >= 0x0B) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1E))
    if len(data) and data.max() >= 0x80:
        rare[:-1] |= (data[:-1] == 0xC2) & (data[1:] == 0x85)
        rare[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] == 0xA8) | (data[2:] == 0xA9))
    return rare


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none null, and where each begins; behind the last, where it ends."""
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[begin[0] : begin[-1]], begin - begin[0]


def _lines_of(texts: pa.StringArray) -> _Lines:
    """As ``str.splitlines`` has them."""
    data, begin = _bytes_of(texts)
    rare = np.flatnonzero(_rare_ends(data))
    if len(rare):
        # These texts are spelled with \n; the lines stay what they are.
        values = texts.to_pylist()
        for at in np.unique(np.searchsorted(begin, rare, "right") - 1).tolist():
            values[at] = "\n".join([*values[at].splitlines(), ""])
        data, begin = _bytes_of(pa.array(values, pa.string()))
    ends = np.flatnonzero(data == 0x0A)
    filled = np.flatnonzero(begin[1:] > begin[:-1])
    unended = filled[data[begin[filled + 1] - 1] != 0x0A] if len(filled) else filled
    n_lines = np.diff(np.searchsorted(ends, begin))
    n_lines[unended] += 1
    # A text without a last line end stops before the first byte of the next one, be that a line end or not.
    has_end = np.insert(np.ones(len(ends), bool), np.searchsorted(ends, begin[unended + 1]), False)
    stop = np.insert(ends, np.searchsorted(ends, begin[unended + 1]), begin[unended + 1])
    first = np.append(0, np.cumsum(n_lines))
    bounds = np.append(0, stop + has_end).astype(np.int32)
    raw = pa.StringArray.from_buffers(len(stop), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return _Lines(first, np.repeat(np.arange(len(texts)), n_lines), raw, np.diff(bounds) - has_end)


def _codes(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal numbers, below the second value."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def _first_places(codes: np.ndarray, n: int, places: int) -> np.ndarray:
    """Of equal codes (below ``n``) the first ``places``, as sorted positions."""
    left, taken = np.arange(len(codes)), []
    while len(left) and len(taken) < places:
        first = np.full(n, len(codes))
        np.minimum.at(first, codes[left], left)
        taken.append(first[first < len(codes)])
        left = left[first[codes[left]] != left]
    return np.sort(np.concatenate(taken)) if taken else left


def _blocks_of(lines: _Lines, bare: pa.DictionaryArray, size: int, places: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Blocks that hold more than comments, of those equal within a text the first ``places``: the numbers
    of their first lines, and for each the place of its fingerprint in the last value. ``bare`` are the lines, stripped."""
    ids, known = bare.indices.to_numpy().astype(np.int64), bare.dictionary
    plain = [pc.equal(known, ""), *[pc.starts_with(known, c) for c in _COMMENTS]]
    is_code = ~reduce(np.logical_or, [p.to_numpy(zero_copy_only=False) for p in plain])
    windows = max(0, len(ids) - size + 1)
    code = is_code[ids]
    holds_code = lines.owner[:windows] == lines.owner[len(ids) - windows :]
    holds_code &= reduce(np.logical_or, [code[k : windows + k] for k in range(size)])
    at = np.flatnonzero(holds_code)
    if not len(at):
        return at, at, pa.array([], pa.binary())
    # Numbers of blocks: of lines' numbers, as digits. They are given anew before they get too large.
    block, n = ids[:windows], len(known)
    for k in range(1, size):
        if n * len(known) * len(lines.first) >= _MOST:
            block, n = _codes(block)
        block, n = block * len(known) + ids[k : windows + k], n * len(known)
    kept = _first_places(*_codes(lines.owner[at] * n + block[at]), places)
    at = at[kept]
    _, example, each = np.unique(block[at], return_index=True, return_inverse=True)
    members = [known.take(pa.array(ids[at[example] + k])) for k in range(size)]
    texts = pc.binary_join_element_wise(*members, "\n").cast(pa.binary())
    return at, each, pa.array([hashlib.sha256(t).digest() for t in texts.to_pylist()], pa.binary())


def _suspects(lines: _Lines, bare: pa.DictionaryArray, languages: list[str | None]) -> np.ndarray:
    """Whether a line may break a rule, or in a long file open or close a function."""
    found = np.zeros(len(lines.owner), bool)
    ids, n_lines = bare.indices.to_numpy(), np.diff(lines.first)
    # Bytes are never fewer than characters.
    long = np.flatnonzero(lines.n_bytes > MAX_LINE_LENGTH)
    if len(long):
        chars = pc.utf8_length(pc.utf8_rtrim(lines.raw.take(pa.array(long)), characters="\n")).to_numpy()
        found[long[chars > MAX_LINE_LENGTH]] = True
    text_language = np.array([list(_NEEDLES).index(x) if x in _NEEDLES else -1 for x in languages], np.int64)
    language = text_language[lines.owner]
    found &= language >= 0

    def search(at: np.ndarray, pattern: str) -> None:
        """No needle begins or ends with white space, so stripped lines do; equal ones are searched once."""
        asked = np.zeros(len(bare.dictionary), bool)
        asked[ids[at]] = True
        some = np.flatnonzero(asked)
        asked[some] = pc.match_substring_regex(bare.dictionary.take(pa.array(some)), pattern).to_numpy(zero_copy_only=False)
        found[at] |= asked[ids[at]]

    for number, (name, pattern) in enumerate(_NEEDLES.items()):
        own = np.flatnonzero(language == number)
        if len(own):
            search(own, pattern)
            if name in BRACE_FUNCTION_LANGUAGES:
                search(own[n_lines[lines.owner[own]] > MAX_FUNCTION_LINES], _pattern(BRACE_NEEDLES))
    return found


def _cut(files: pa.RecordBatch, size: int, places: int | None) -> pa.RecordBatch:
    """The rows of some files (review_id, file_path, language, content)."""
    lines = _lines_of(pc.fill_null(files.column(3), ""))
    bare = pc.utf8_trim(lines.raw, characters=WHITE_SPACE).dictionary_encode()
    at, prints, digests = _blocks_of(lines, bare, size, sys.maxsize if places is None else places)
    suspects = _suspects(lines, bare, files.column(2).to_pylist())
    empty = np.diff(lines.first) == 0
    kept = suspects.copy() if places is not None else np.ones(len(suspects), bool)
    kept[at] = True
    kept[lines.first[:-1][~empty]] = True
    kept = np.flatnonzero(kept)
    block = np.full(len(suspects), -1)
    block[at] = prints
    line = lines.raw.take(pa.array(kept, mask=~suspects[kept]))
    none = np.flatnonzero(empty)
    owner, line_no = np.append(lines.owner[kept], none), np.append(kept - lines.first[lines.owner[kept]] + 1, none)
    n_lines = np.diff(lines.first)[owner]
    is_null = files.column(3).is_null().to_numpy(zero_copy_only=False)[owner]
    columns = [
        *[files.column(c).take(pa.array(owner)) for c in range(3)],
        pa.array(n_lines.astype(np.int32), mask=is_null),
        pa.array(line_no.astype(np.int32), mask=np.arange(len(owner)) >= len(kept)),
        pa.concat_arrays([pc.utf8_rtrim(line, characters="\n"), pa.nulls(len(none), pa.string())]),
        pa.concat_arrays([digests.take(pa.array(block[kept], mask=block[kept] < 0)), pa.nulls(len(none), pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_CUT)


def scan_texts(files: DataFrame, size: int = BLOCK_LINES, places: int | None = None) -> DataFrame:
    """One row for each line of each file, and one without a line number for an empty file.

    Columns: review_id, file_path, language, n_lines, line_no, n_chars (of lines that may break
    a rule), bits, opened, closed, name, fingerprint. Braces are counted only in files that can
    hold an overlong function. With ``places``, blocks that are equal within a file are marked at
    the first so many places, and lines that carry nothing are left out but for the first.
    Nothing is shuffled here.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are cut up some GROUP_BYTES at a time, by operations on all their lines at once."""
        for taken in batches:
            taken = pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in taken.columns], names=taken.schema.names)
            n_bytes = np.cumsum(pc.fill_null(pc.binary_length(taken.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < taken.num_rows:
                before = n_bytes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(n_bytes, before + GROUP_BYTES, "right")))
                rows = _cut(taken.slice(begin, end - begin), size, places)
                yield from (rows.slice(at, BATCH_ROWS) for at in range(0, rows.num_rows, BATCH_ROWS))
                begin = end

    texts = files.select("review_id", "file_path", "language", F.make_valid_utf8("content").alias("content"))
    line = F.col("line")
    braced = F.col("language").isin(BRACE_FUNCTION_LANGUAGES) & (F.col("n_lines") > MAX_FUNCTION_LINES)
    return texts.mapInArrow(cut, CUT_SCHEMA).select(
        "review_id",
        "file_path",
        "language",
        "n_lines",
        "line_no",
        F.length(line).alias("n_chars"),
        F.coalesce(rule_bits(F.coalesce("language", F.lit("")), line), F.lit(0).cast("long")).alias("bits"),
        *brace_columns(F.when(braced, line)),
        "fingerprint",
    )


def lines_with_hits(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("bits") != 0).select("review_id", "file_path", "line_no", "n_chars", "bits")


def braces(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("opened").isNotNull()).select(
        "review_id", "file_path", "n_lines", "line_no", "opened", "closed", "name"
    )


def blocks(texts: DataFrame) -> DataFrame:
    """The blocks as ``duplicates.shingles`` has them, at those places that the scan has marked."""
    found = texts.where(F.col("fingerprint").isNotNull())
    return found.select("review_id", "file_path", F.col("line_no").alias("line_start"), "fingerprint")


def _heads(texts: DataFrame) -> Column:
    """One row of each file: its first line, or the row of an empty one."""
    return F.coalesce(F.col("line_no"), F.lit(1)) == 1


def counted_lines(texts: DataFrame) -> DataFrame:
    """review_id, file_path, language, line_count of every file, as ``scoring.line_counts`` has them."""
    return texts.where(_heads(texts)).select(
        "review_id", "file_path", F.coalesce("language", F.lit("unknown")).alias("language"), F.col("n_lines").alias("line_count")
    )


def large_files(texts: DataFrame) -> DataFrame:
    return overlong_files(texts.where((F.col("line_no") == 1) & F.col("language").isin(list(LANGUAGE_RULES))))
