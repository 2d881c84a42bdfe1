"""Removal of repeated paragraphs and passages.

Paragraphs are the lines of a text with at least MIN_WORDS words; shorter lines
in a row are joined to blocks of MIN_WORDS words or a little more, and the last
block before a long line or the text's end may be shorter, so every word lies in
a paragraph. Each gets a MinHash sketch of its five-word shingles (all its words
as one, if they are fewer) in BANDS bands of ROWS rows: of two paragraphs with a
Jaccard similarity of 0.8 more than 99 in 100 collide in a band. Colliding paragraphs are verified by their exact Jaccard similarity and
clustered by connected components. A passage inside longer paragraphs is found
as well: windows of WINDOW words start at the places that winnowing chooses (one
in any ANCHOR successive places, by content), so a passage of ANCHOR + WINDOW - 1
words or more that repeats has a window in common; windows collide when all
their words are equal.

Of each cluster the first place (by id, then by position) stays; the others are
removals, merged to spans of words. Equal paragraphs are one vertex, so copies
make no pairs.

Defined cases: a null text has no words, and stays null. Rows without an id
come after those with one; rows with the same id are told apart by their text,
and repeated rows are one place and share their spans. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, fresh, key_of, slices, written
from lintmill.llm.graph import components
from lintmill.llm.ngram_join import _Hashes, _mix, links

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 8, 3
MIN_WORDS = 20
ANCHOR, WINDOW = 20, 32

_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = re.compile(rb"[^ \t-\r]+")


def _shingle_hashes(ids: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Distinct hashes of each paragraph's shingles, from the text's word hashes."""
    if not spans:
        return []
    mixed = _mix(ids)

    def shingles(words: np.ndarray, size: int) -> np.ndarray:
        count = max(0, len(words) - size + 1)
        total = np.full(count, size, np.uint64)
        for i in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : count + i]
        return _mix(total)

    total = shingles(mixed, SHINGLE)
    return [np.unique(total[a : b - SHINGLE + 1]) if b - a >= SHINGLE else shingles(mixed[a:b], b - a) for a, b in spans]


def _vertices(sets: list[np.ndarray]) -> list[int]:
    """A signed hash of each set."""
    sizes = np.array([len(grams) for grams in sets], np.uint64)
    sums = np.add.reduceat(_mix(np.concatenate(sets)), np.cumsum(sizes, dtype=np.int64) - sizes.astype(np.int64))
    return (sums + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each band of each set's sketch; one seed after the other over all sets."""
    sizes = np.array([len(grams) for grams in sets], np.int64)
    grams, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    # Grams are mixed hashes already; an odd factor gives each seed an order of its own.
    least = np.stack([np.minimum.reduceat(grams * seed, starts) for seed in _SEEDS | np.uint64(1)], 1).reshape(-1, BANDS, ROWS)
    return _mix((least * (_SEEDS[:ROWS] | np.uint64(1))).sum(2, dtype=np.uint64) + _SEEDS[:BANDS])


def _windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed hash of the WINDOW words from each place on, by differences of running sums."""
    powers, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(ids) - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(ids) * powers, dtype=np.uint64)])
    return _mix((sums[at + WINDOW] - sums[at]) * inverse[at]).view(np.int64)


def paragraphs(text: str | None, hashes: _Hashes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The text's word hashes, and (start, end) in words of its paragraphs."""
    words, spans, open_ = [], [], 0  # short lines from open_ on wait for their block to fill
    for line in (text or "").encode().lower().split(b"\n"):
        found = line.split()
        if len(found) >= MIN_WORDS and open_ < len(words):
            spans.append((open_, len(words)))
            open_ = len(words)
        words += found
        if len(words) - open_ >= MIN_WORDS:
            spans.append((open_, len(words)))
            open_ = len(words)
    if open_ < len(words):
        spans.append((open_, len(words)))
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), spans


def anchors(ids: np.ndarray) -> np.ndarray:
    """Starts of windows: the least hash of three words in any ANCHOR successive places."""
    if len(ids) < WINDOW:
        return np.empty(0, np.int64)
    mixed = _mix(ids)
    place = _mix(mixed[:-2] * np.uint64(3) + mixed[1:-1] * np.uint64(5) + mixed[2:] * np.uint64(7))
    # The first least place of each window, by doubling the windows' width.
    first, least, width = np.arange(len(place), dtype=np.int32), place, 1
    while width < min(ANCHOR, len(place)):
        step = min(width, ANCHOR - width, len(place) - width)
        left = least[: len(least) - step] <= least[step:]
        first = np.where(left, first[: len(left)], first[step:])
        least = np.where(left, least[: len(left)], least[step:])
        width += step
    found = first[np.append(True, first[1:] != first[:-1])].astype(np.int64)
    return found[found + WINDOW <= len(ids)]


_UNIT = pa.struct([("v", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32())])


def _units(docs: DataFrame) -> DataFrame:
    """Of ``docs(id, key, text)``: id, key, n_words, n_paragraphs, units (v, start, end, size; size 0: a window), bands (v, size, region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            for part in slices(batch, 2):
                counts, lengths, unit_ends, band_ends, units, new, fresh_sets = [], [], [0], [0], [], [], []
                for text in part.column(2).to_pylist():
                    ids, spans = paragraphs(text, hashes)
                    counts.append(len(spans))
                    lengths.append(len(ids))
                    if spans:
                        sets = _shingle_hashes(ids, spans)
                        found = _vertices(sets)
                        units.append(np.array([(v, start, end, len(grams)) for v, (start, end), grams in zip(found, spans, sets, strict=True)], np.int64))
                        for v, grams in zip(found, sets, strict=True):
                            if v not in seen:
                                seen.add(v)
                                fresh_sets.append((v, len(grams)))
                                new.append(grams)
                    at = anchors(ids)
                    if len(at):
                        units.append(np.stack([_windows(ids, at), at, at + WINDOW, np.zeros(len(at), np.int64)], 1))
                    unit_ends.append(unit_ends[-1] + len(spans) + len(at))
                    band_ends.append(BANDS * len(new))
                flat = np.concatenate([np.empty((0, 4), np.int64), *units])
                u = pa.StructArray.from_arrays([pa.array(flat[:, i]).cast(_UNIT[i].type) for i in range(4)], fields=list(_UNIT))
                sets = np.repeat(np.array(fresh_sets, np.int64).reshape(-1, 2), BANDS, axis=0)
                regions = (_bands(new).ravel() if new else np.empty(0, np.uint64)).view(np.int64)
                b = pa.StructArray.from_arrays([pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array(regions)], ["v", "size", "region"])
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((unit_ends, u), (band_ends, b))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lengths, pa.int64()), pa.array(counts, pa.int64()), *lists], ["id", "key", "n_words", "n_paragraphs", "units", "bands"])

    unit, band = "array<struct<v:bigint,start:int,end:int,size:int>>", "array<struct<v:bigint,size:bigint,region:bigint>>"
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, key binary, n_words long, n_paragraphs long, units {unit}, bands {band}")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, grams) of the ``wanted`` paragraphs that occur in ``docs(text)``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            for part in slices(batch, 0):
                found = {}
                for text in part.column(0).to_pylist():
                    ids, spans = paragraphs(text, hashes)
                    sets = _shingle_hashes(ids, spans)
                    for v, grams in zip(_vertices(sets) if sets else [], sets, strict=True):
                        if v not in seen:
                            seen.add(v)
                            found[v] = grams.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["v", "grams"])

    return docs.mapInArrow(run, "v long, grams binary").join(wanted, "v", "left_semi").dropDuplicates(["v"])


def find_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``id``, key, n_words, n_paragraphs, ``repeated`` and ``removed`` (arrays of (start, end) in words, sorted) of every row."""
    # As bytes the digest takes half the room in every place that is moved.
    slim = docs.select(F.col(ident).alias("id"), F.unhex(key_of(F.col(ident), F.col(text))).alias("key"), F.col(text).alias("text"))
    sketched = written(_units(slim), "paragraph_sketches")
    banded = sketched.select(F.explode("bands").alias("b")).select("b.v", "b.size", "b.region")
    shared = written(banded.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region"), "shared_bands")
    regions = written(banded.join(shared, "region", "left_semi").distinct(), "paragraph_regions")
    wanted = written(regions.select("v").distinct(), "paragraphs_wanted")
    holders = sketched.select("key", F.explode("units").alias("u")).where("u.size > 0").select("key", "u.v").join(wanted, "v", "left_semi")
    holders = written(holders.groupBy("v").agg(F.min("key").alias("key")).select("key").distinct(), "paragraph_holders")
    sets = written(_sets(slim.join(broadcast_if_small(holders, 64), "key", "left_semi").select("text"), wanted), "paragraph_sets")
    roots = written(components(links(regions, sets, PERCENT)), "paragraph_roots")

    places = sketched.select("id", "key", F.explode("units").alias("u")).select("id", "key", "u.v", "u.start", "u.end", (F.col("u.size") == 0).alias("window"))
    # Nearly all places are alone with their content: count first, then move only the others.
    many = places.groupBy("v", "window").agg(F.count(F.lit(1)).alias("n")).join(roots.withColumn("window", F.lit(False)), ["v", "window"], "left")
    many = written(many.where("n > 1 or root is not null").select("v", "window", F.coalesce("root", "v").alias("cluster")), "repeated_units")
    met = written(places.join(many, ["v", "window"]), "repeated_places")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "start", "end")
    first = met.groupBy("cluster", "window").agg(F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("first") != F.col("last"))
    judged = met.join(written(first.drop("last"), "first_places"), ["cluster", "window"])
    span = F.struct("start", "end")
    spans = judged.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("repeated"), F.sort_array(F.collect_set(F.when(order != F.col("first"), span))).alias("removed"))
    spans = written(spans, "repeated_spans")
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = sketched.select("id", "key", "n_words", "n_paragraphs").join(spans, "key", "left")
    key = F.lower(F.hex("key")).alias("key")
    return rows.select("id", key, "n_words", "n_paragraphs", *[merged(F.coalesce(c, none)).alias(c) for c in ("repeated", "removed")])


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap joined."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (last["end"] >= span["start"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, start, add)


def words_in(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space between them."""
    data = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def remove_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with every repeated paragraph and passage left in its first place only."""
    key, spans = fresh(docs, "_key"), fresh(docs, "_spans")
    found = find_repeats(docs, text, ident).where(F.size("removed") > 0)
    found = written(found.dropDuplicates(["key"]).select(F.col("key").alias(key), F.col("removed").alias(spans)), "removals")
    found = broadcast_if_small(found, F.size(spans) * 16 + 96)
    joined = docs.join(found, key_of(F.col(ident), F.col(text)) == F.col(key), "left").drop(key)
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_words(t, [(s["start"], s["end"]) for s in x]) if x and t is not None else t for t, x in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 : len(names)]], names)

    return joined.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes))
