"""Benchmark decontamination by a prefix-filtered containment join. [native]

An item is cut into windows of WINDOW words (a shorter item is one window), and
a window into shingles of SHINGLE words. A window that a document contains has
all its shingles there, so for containment 1 a prefix of one shingle is needed:
the one that is rarest over all documents. Its place in the document fixes where
the window would start (positional bound), which has to leave room for it
(length bound); the words there are then compared one by one.

The prefix table is broadcast in blocks, each with a measured size below the
bound, so documents are never shuffled by shingle; only hits are, by document.

Defined cases: a null text has no words. An item without words has no window.
Items without an id count as hits but are not listed. Repeated document rows
each give a row. Without items every document has no hit. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import BROADCAST_BYTES, fresh, key_of, let, lower_ascii, written

WINDOW = 10
SHINGLE = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(words: Column, length: int) -> Column:
    """Array of (i, h): place and hash of each run of ``length`` words."""
    def at(i: Column) -> Column:
        return F.struct(i.alias("i"), F.xxhash64(*[F.get(words, i + j) for j in range(length)]).alias("h"))

    enough = F.size(words) >= length
    return F.when(enough, F.transform(F.sequence(F.lit(0), F.size(words) - length), at)).otherwise(F.array().cast("array<struct<i:int,h:bigint>>"))


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows (w, size, item_ids) of ``items(item_id, text)``."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))

    def cut(words: Column) -> Column:
        size = F.least(F.size(words), F.lit(window))
        starts = F.sequence(F.lit(1), F.size(words) - size + 1)
        return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i, size)))

    rows = split.select("item_id", F.explode(let(F.col("words"), cut)).alias("w"))
    return rows.groupBy(F.array_join("w", " ").alias("text")).agg(F.any_value("w").alias("w"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _blocks(df: DataFrame, size: Column, by: str) -> Iterator[DataFrame]:
    """The table in blocks, with a broadcast hint on each whose measured size allows it."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    count = max(1, math.ceil(2 * total / BROADCAST_BYTES))
    if count == 1:
        yield F.broadcast(df)
        return
    numbered = df.withColumn("_block", F.pmod(F.xxhash64(by), F.lit(count)))
    sizes = {r[0]: r[1] for r in numbered.groupBy("_block").agg(F.sum(size)).collect()}  # a number for each block
    for block, bytes_ in sizes.items():
        part = numbered.where(F.col("_block") == block).drop("_block")
        yield F.broadcast(part) if bytes_ <= BROADCAST_BYTES else part


def prefixes(docs: DataFrame, windows: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """For each window its shingle that is rarest in ``docs``: (h, off, length, w, item_ids)."""
    length = F.least(F.size("w"), F.lit(shingle))
    grams = F.lit(None).cast("array<struct<i:int,h:bigint>>")
    for n in range(1, shingle + 1):
        grams = F.when(length == n, _shingles(F.col("w"), n)).otherwise(grams)
    rows = windows.select("text", "w", "item_ids", length.alias("length"), F.inline(grams))
    rows = written(rows, "decontamination_shingles")
    lengths = [r[0] for r in rows.select("length").distinct().collect()]  # at most SHINGLE numbers
    if not lengths:
        return rows.select("h", F.col("i").alias("off"), "length", "w", "item_ids")
    counts = []
    for block in _blocks(rows.select("h").distinct(), F.lit(48), "h"):
        found = _document_shingles(docs.select(F.col(text).alias("_t")), "_t", lengths, []).select("g.h")
        counts.append(found.join(block, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    counts = written(reduce(DataFrame.unionByName, counts), "decontamination_counts")
    ranked = rows.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # The rarest shingle; ties go by hash, then by place.
    best = ranked.groupBy("text").agg(F.min(F.struct("n", "h", "i")).alias("p"), *[F.any_value(c).alias(c) for c in ("w", "item_ids", "length")])
    return best.where(F.col("p.n") > 0).select("p.h", F.col("p.i").alias("off"), "length", "w", "item_ids")


def _document_shingles(docs: DataFrame, text: str, lengths: list[int], carried: list[str], head: bool = False) -> DataFrame:
    """A row (carried, words, g) for every shingle of the documents; ``head``: and one with a null hash for each document."""
    first = [F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("long").alias("h")))] if head else []

    def both(words: Column) -> Column:
        grams = [_shingles(words, n) for n in lengths]
        return F.struct(words.alias("words"), F.concat(*first, *grams).alias("grams"))

    split = docs.select(*carried, let(words_of(F.col(text)), both).alias("s"))
    return split.select(*carried, F.col("s.words").alias("words"), F.explode("s.grams").alias("g"))


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``keys``, ``key`` (a digest of keys and text), n_words, hits (start, size in words) and item_ids of every document row."""
    table = written(prefixes(docs, windows_of(items, window, shingle), text, shingle), "decontamination_prefixes")
    lengths = [r[0] for r in table.select("length").distinct().collect()]
    keyed = docs.select(*[F.col(k).alias(f"k_{k}") for k in keys], key_of(*[F.col(k) for k in keys], F.col(text)).alias("_key"), F.col(text).alias("_t"))
    carried = [*[f"k_{k}" for k in keys], "_key"]
    size = F.aggregate("w", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + F.size("item_ids") * 24 + 96
    found = []
    for block in _blocks(table, size, "h"):
        rows = _document_shingles(keyed, "_t", lengths, carried, head=not found)
        start, wide = F.col("g.i") - F.col("off"), F.size("w")
        holds = (start >= 0) & (start + wide <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, wide) == F.col("w"))
        hit = F.coalesce(holds, F.lit(False))
        joined = rows.join(block, F.col("g.h") == F.col("h"), "left").where((F.col("g.i") < 0) | hit)
        found.append(joined.select(
            *carried,
            F.when(F.col("g.i") < 0, F.size("words").cast("long")).alias("n_words"),
            F.when(F.col("g.i") >= 0, F.struct(start.alias("start"), wide.alias("size"))).alias("hit"),
            F.when(F.col("g.i") >= 0, F.col("item_ids")).alias("item_ids"),
        ))
    hits = reduce(DataFrame.unionByName, found)
    grouped = hits.groupBy(*carried).agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("rows"),
        F.sort_array(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    named = [F.col(f"k_{k}").alias(k) for k in keys]
    many = grouped.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return many.select(*named, F.col("_key").alias("key"), "n_words", "hits", "item_ids")


def covered(hits: Column) -> Column:
    """Words that lie in any of the sorted hits."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, hit: Column) -> Column:
        end = hit["start"] + hit["size"]
        new = F.greatest(end - F.greatest(acc["end"], hit["start"]), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"].cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), **sizes: int) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    name = fresh(docs, "_key")
    bad = find_hits(docs, items, text, keys, **sizes).where(F.size("hits") > 0).select(F.col("key").alias(name)).distinct()
    bad = written(bad, "contaminated")
    count = bad.count()
    bad = F.broadcast(bad) if count * 64 <= BROADCAST_BYTES else bad
    return docs.join(bad, key_of(*[F.col(k) for k in keys], F.col(text)) == F.col(name), "left_anti")
