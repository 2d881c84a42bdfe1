"""A trigram index of review texts, for searches that match somewhere inside a text.

Every review's searchable texts (titles, explanations and paths of its issues, its
summary and report) are filed twice: the texts themselves in buckets by review, and
postings in buckets by gram. Stored texts lie by review, so they are cut into segments where
they are read: a segment numbers its reviews from 0, and a posting is a gram of a segment with
the numbers of the reviews that have it. A gram of a review is two bytes on its way to its
bucket, and nothing is shuffled to make grams different. A review that lies in two segments is
numbered in both, which loses nothing: one text must have all grams, and a text lies in one.

A search cuts the literal parts of its pattern into grams, reads the postings of these only,
and keeps the reviews of a segment that have all of them. The texts of those reviews, in their
buckets alone, are then held against the pattern itself, so the result is what a scan of
everything would give. A pattern without three letters in a row has no gram and needs the scan.

Runs are appended like those of ``sinks.write_children``: the rows first, then a row for each
review that names the run. Of a review only its last named run counts.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.sources.runs import BUCKETS, review_bucket

#: Letters of a gram, and folders that postings are dealt into.
GRAM, GRAM_BUCKETS = 3, 256

#: Bytes of texts in a segment, about, and how many reviews its numbers can tell apart.
SEGMENT_BYTES, SEGMENT_REVIEWS = 2_000_000, 32_767
#: The folder of rows that hold the reviews of a segment, by number, in place of a gram.
_REVIEWS_OF = -1

_TEXTS = "review_id string, text string, review_bucket int, run long"
_SEGMENTS = "segment long, gram string, numbers array<smallint>, reviews array<string>"
#: Before there were segments a posting named one review.
_POSTINGS = f"{_SEGMENTS}, review_id string, gram_bucket int, run long"


def like_parts(pattern: str) -> list[str]:
    """The literal parts of a LIKE pattern, between its wildcards."""
    parts, text = [""], iter(pattern)
    for c in text:
        if c in "%_":
            parts.append("")
        else:
            parts[-1] += next(text, "") if c == "\\" else c
    return [p for p in parts if p]


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them."""
    bound = int(values.max(initial=0)) + 1
    if bound > 1 << 22:
        return np.unique(values, return_inverse=True)
    place = np.zeros(bound, np.int64)
    place[values] = 1
    different = np.flatnonzero(place)
    place[different] = np.arange(len(different))
    return different, place[values]


def _segment(segment: int, ids: pa.StringArray, texts: pa.StringArray) -> Iterator[pa.RecordBatch]:
    """The postings of some texts in lower case, after a row with their reviews."""
    coded, spelt = ids.dictionary_encode(), texts.dictionary_encode()
    n = len(coded.dictionary)
    # Equal texts of a review count once.
    pairs, once = np.unique(coded.indices.to_numpy().astype(np.int64) * len(spelt.dictionary) + spelt.indices.to_numpy(), return_index=True)
    numbered, texts = pairs // len(spelt.dictionary), texts.take(pa.array(once))
    low = [t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    letters, coded_letters = _places(np.frombuffer("".join(low).encode("utf-32-le"), np.uint32))
    # A gram is one number; those that run over the end of a text are none.
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(coded_letters))
    begins, base = np.flatnonzero(left >= GRAM), max(len(letters), 1)
    grams = np.zeros(len(begins), np.int64)
    for k in range(GRAM):
        grams = grams * base + coded_letters[begins + k]
    different, at = _places(grams)
    pairs = np.sort(at * n + np.repeat(numbered, sizes)[begins])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    starts = np.searchsorted(pairs, np.arange(len(different) + 1) * n)
    spelled = np.stack([letters[different // base ** (GRAM - 1 - k) % base] for k in range(GRAM)], axis=1)
    text = spelled.astype("<u4").tobytes().decode("utf-32-le")
    m = len(different)
    names = [None, *(text[i : i + GRAM] for i in range(0, GRAM * m, GRAM))]
    numbers = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pairs % n, pa.int16()))
    columns = [
        pa.array([segment] * (m + 1), pa.int64()),
        pa.array(names, pa.string()),
        pa.concat_arrays([pa.nulls(1, numbers.type), numbers]),
        pa.concat_arrays([pa.ListArray.from_arrays([0, n], coded.dictionary), pa.nulls(m, pa.list_(pa.string()))]),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["segment", "gram", "numbers", "reviews"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (review_id, text), of so many rows at a time as make a segment."""
    # The same files give the same segments if a task runs again.
    first = TaskContext.get().partitionId() << 32
    made, held, size = 0, [], 0

    def cut() -> Iterator[pa.RecordBatch]:
        nonlocal made
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, texts = (pa.concat_arrays(c.chunks) for c in rows.columns)
        parts = [(ids, texts)]
        while parts:
            ids, texts = parts.pop()
            # A batch of long texts is more than one segment.
            too_long = len(ids) > 1 and texts.nbytes > 2 * SEGMENT_BYTES
            if too_long or len(ids) > SEGMENT_REVIEWS and len(ids.unique()) > SEGMENT_REVIEWS:
                half = len(ids) // 2
                parts += [(ids[:half], texts[:half]), (ids[half:], texts[half:])]
                continue
            yield from _segment(first + made, ids, texts)
            made += 1

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= SEGMENT_BYTES:
            yield from cut()
            held, size = [], 0
    if held:
        yield from cut()


def _gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def issue_texts(issues: DataFrame) -> DataFrame:
    """(review_id, text) of what a search looks at in issues; equal texts of a review as often as they occur."""
    texts = issues.select("review_id", F.explode(F.array("title", "explanation", "file_path")).alias("text"))
    return texts.where(F.col("text").isNotNull())


def own_texts(reviews: DataFrame) -> DataFrame:
    """(review_id, text) of what a search looks at in review rows."""
    texts = F.array_compact(F.array("summary", "report_markdown"))
    return reviews.select(F.col("id").alias("review_id"), F.explode(texts).alias("text"))


@dataclass(frozen=True)
class TextIndex:
    """The index in a folder."""

    spark: SparkSession
    folder: str

    def append(self, texts: DataFrame, reviews: DataFrame) -> None:
        """File the texts (review_id, text) of ``reviews`` (review_id), in place of all that is filed of them.

        The texts are moved once, to their buckets.
        """
        run = time.time_ns()
        rows = texts.select("review_id", "text", review_bucket(F.col("review_id")).alias("review_bucket"), F.lit(run).alias("run"))
        # A review's texts lie side by side, so that a segment has all of them.
        placed = rows.hint("rebalance", "review_bucket").sortWithinPartitions("review_bucket", "run", "review_id")
        placed.write.mode("append").partitionBy("review_bucket", "run").parquet(f"{self.folder}/texts")
        stored = self._texts().where((F.col("run") == run) & F.col("review_id").isNotNull() & F.col("text").isNotNull())
        cut = stored.select("review_id", F.lower("text").alias("text")).mapInArrow(_segments, _SEGMENTS)
        bucket = F.when(F.col("gram").isNull(), _REVIEWS_OF).otherwise(_gram_bucket(F.col("gram")))
        filed = cut.select("*", bucket.alias("gram_bucket"), F.lit(run).alias("run"))
        ordered = filed.hint("rebalance", "gram_bucket").sortWithinPartitions("gram_bucket", "run", "gram")
        ordered.write.mode("append").partitionBy("gram_bucket", "run").parquet(f"{self.folder}/postings")
        reviews.select("review_id", F.lit(run).alias("run")).distinct().write.mode("append").parquet(f"{self.folder}/runs")

    def _texts(self) -> DataFrame:
        return self.spark.read.schema(_TEXTS).parquet(f"{self.folder}/texts")

    def _last(self) -> DataFrame:
        runs = self.spark.read.schema("review_id string, run long").parquet(f"{self.folder}/runs")
        return runs.groupBy("review_id").agg(F.max("run").alias("run"))

    def lowered_parts(self, pattern: str) -> list[str]:
        """Literal parts as the engine's own lower case has them."""
        [row] = self.spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).collect()
        return like_parts(row.p)

    def grams_of(self, pattern: str) -> list[str]:
        """The grams that a text must have to fit the pattern; none if its parts are too short."""
        return sorted({p[i : i + GRAM] for p in self.lowered_parts(pattern) for i in range(len(p) - GRAM + 1)})

    def candidates(self, grams: list[str]) -> DataFrame:
        """(review_id, run) of reviews that have all the grams somewhere."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = [r.b for r in asked.select(_gram_bucket(F.col("gram")).alias("b")).distinct().collect()]
        postings = self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings")
        found = postings.where(F.col("gram_bucket").isin(buckets) & F.col("gram").isin(grams))
        # A segment has a gram once, so each of its lists is of another one.
        lists = found.where(F.col("segment").isNotNull()).groupBy("run", "segment").agg(F.collect_list("numbers").alias("lists"))
        common = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
        numbers = lists.where(F.size("lists") == len(grams)).select("run", "segment", common.alias("numbers")).where(F.size("numbers") > 0)
        named = postings.where(F.col("gram_bucket") == _REVIEWS_OF).select("run", "segment", "reviews").join(numbers, ["run", "segment"])
        units = named.select(F.explode(F.transform("numbers", lambda k: F.get("reviews", k.cast("int")))).alias("review_id"), "run")
        single = found.where(F.col("review_id").isNotNull()).groupBy("review_id", "run").agg(F.count(F.lit(1)).alias("n"))
        all_of = units.unionByName(single.where(F.col("n") == len(grams)).select("review_id", "run"))
        return all_of.distinct().join(self._last(), ["review_id", "run"], "left_semi")

    def matching(self, pattern: str) -> DataFrame | None:
        """(review_id) of reviews with a text that is LIKE the pattern in any case; None if that needs a scan."""
        grams = self.grams_of(pattern)
        if not grams:
            return None
        found = self.candidates(grams)
        # Few candidates lie in few buckets; the others are not opened.
        lie_in = found.select(review_bucket(F.col("review_id")).alias("b")).distinct().limit(BUCKETS)
        buckets = [r.b for r in lie_in.collect()]
        texts = self._texts().where(F.col("review_bucket").isin(buckets)).join(found, ["review_id", "run"], "left_semi")
        return texts.where(F.col("text").ilike(pattern)).select("review_id").distinct()
