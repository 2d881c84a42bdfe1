"""Toxicity by class-conditional Kneser-Ney models.

Two models read the bytes of words, one learned from toxic texts, one from
ordinary ones. A byte is predicted from the ORDER - 1 bytes before it, not
beyond the start of its word; letters and digits make words, everything else is
one separator. A class's probability of a byte after a context is its discounted share
in that class, and what the discounts and a weight THETA set free goes to the
*shared* Kneser-Ney estimate over both classes (whose lower orders count
different contexts instead of occurrences). Expressions that are rare in a class
therefore cost both models about the same, and what is known of one form of a
word tells on its other forms. A gram counts once for each text that has it, and equal texts
of a class count once, so neither repeated lines nor copies teach.

Both log-likelihoods are divided by a length and subtracted: over stretches of
WINDOW bytes, since a few words make a long text toxic; each gram counts where it
stands first. The best stretch's difference is turned into a probability by a
logistic curve, fitted on FOLD-th of the labelled texts that the counts leave out.

The difference is a sum of one weight for each gram. The weights of all grams
that were learned are a written table; nothing is left out of it. If it is measured
below BROADCAST_BYTES it is broadcast; otherwise texts are dealt into chunks, and each chunk
meets the weights of its own grams by joins. Weights are whole numbers (units of 2 ** -20), so
both ways give the same sums.

Defined cases: null and empty texts have no grams, their difference is 0 and they get the
probability of that. A document is toxic if any of its label rows says 1, and unlabelled if all
are null; labels of unknown documents are ignored. Without toxic or without ordinary labels to learn
from, every score is 0 or so near to it as the prior leaves it. Repeated rows are scored each by
itself. Very long texts count like others. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm import common
from lintmill.llm.common import broadcast_if_small, slices, written

#: Bytes of a gram, of them the last is predicted.
ORDER = 5
#: Discounts of the shared and of the class estimates, and the weight of the shared one in counts.
SHARED_DISCOUNT, DISCOUNT, THETA = 0.75, 1.0, 5.0
#: Bytes of a stretch.
WINDOW = 32
#: One labelled text in so many is kept for the curve.
FOLD = 5
#: Weights and differences are multiples of 1 / SCALE; the curve is fitted on differences in steps of 1 / STEPS.
SCALE, STEPS = 1 << 20, 512
#: Precision of the curve's prior: a slope of about SLOPE, a start at one toxic text in ten.
SLOPE, PRIOR = 30.0, (-2.2, 0.05, 0.002)
#: Grams that a task counts before it passes its sums on.
COUNTED = 4_000_000
#: Bytes of texts in a chunk where the weights are too large to broadcast.
CHUNK_BYTES = 16 << 20

_WORD = np.array([97 <= i <= 122 or 48 <= i <= 57 or i >= 128 for i in range(256)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the grams of all texts, one after the other, and where each text's end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # A separator before each text, so that no context reaches into the text before.
    data = np.frombuffer(b"".join(b" " + t for t in texts).lower(), np.uint8)
    word = _WORD[data]
    symbols = np.where(word, data, 32).astype(np.int64)
    places = np.arange(len(data))
    gap = np.maximum.accumulate(np.where(word, 0, places))
    # The separator before a byte's word; for a separator, that before the word it ends.
    start = np.append(0, gap[:-1])
    codes = symbols.copy()
    for back in range(1, min(ORDER, len(data))):
        codes[back:] |= np.where(places[back:] - back >= start[back:], symbols[:-back], 0) << 8 * back
    kept = word.copy()
    kept[1:] |= word[:-1]
    # A text's first separator ends no word of its own.
    kept[np.cumsum(sizes) - sizes] = False
    return codes[kept], np.cumsum(np.add.reduceat(kept, np.cumsum(sizes) - sizes)) if texts else np.empty(0, np.int64)


def first_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, ends, new): whether a gram stands for the first time in its text."""
    codes, ends = grams(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    new = np.zeros(len(codes), bool)
    new[np.unique(of << 8 * ORDER | codes, return_index=True)[1]] = True
    return codes, ends, new


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, toxic, fits): the documents to learn from, one for each text of a class; ``fits`` marks those for the curve.

    ``labels`` has (key, label); only its documents are looked at.
    """
    known = written(labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) == 1).cast("int")).alias("toxic")), "toxic_labels")
    texts = docs.select(key, F.xxhash64(text).alias("mark")).where(F.length(F.coalesce(F.col(text), F.lit(""))) > 0)
    found = texts.join(broadcast_if_small(known, 16), key).groupBy("toxic", "mark").agg(F.min(key).alias(key))
    return written(found.select(key, "toxic", (F.pmod("mark", F.lit(FOLD)) == 0).alias("fits")), "toxic_texts")


def count_grams(rows: DataFrame, toxic: str, text: str) -> DataFrame:
    """(code, toxic, ordinary): texts of each class that have a gram; tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes, bad, good = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, place = np.unique(codes, return_inverse=True)
            return unique, *(np.bincount(place, n, len(unique)).astype(np.int64) for n in (bad, good))

        for batch in batches:
            for part in slices(batch, 1):
                codes, ends, new = first_grams([(t or "").encode() for t in part.column(1).to_pylist()])
                bad = np.repeat(part.column(0).to_numpy(zero_copy_only=False) == 1, np.diff(ends, prepend=0))
                held.append((codes[new], bad[new].astype(np.int64), (~bad[new]).astype(np.int64)))
                if sum(len(x[0]) for x in held) > COUNTED:
                    held[:] = [merged()]
                    if len(held[0][0]) > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["code", "toxic", "ordinary"])
                        held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["code", "toxic", "ordinary"])

    counted = rows.select(toxic, text).mapInArrow(run, "code long, toxic long, ordinary long")
    return counted.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def weigh(counts: DataFrame) -> DataFrame:
    """(code, weight): log of the toxic over the ordinary probability of every gram's last byte, in units of 1 / SCALE."""
    levels = [counts.select("code", (F.col("toxic") + F.col("ordinary")).alias("n"))]
    for order in range(ORDER - 1, 0, -1):
        # A shorter gram counts the different bytes that stand before it.
        shorter = F.col("code").bitwiseAND((1 << 8 * order) - 1)
        levels.append(written(levels[-1].groupBy(shorter.alias("code")).agg(F.count(F.lit(1)).alias("n")), "shorter_grams"))
    context = F.shiftright("code", 8)
    low = None
    for order, level in enumerate(reversed(levels), 1):
        sums = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        level = level.withColumn("context", context).join(sums, "context")
        if low is None:
            level = level.withColumn("low", F.lit(1 / 256))
        else:
            level = level.withColumn("shorter", F.col("code").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(low.select(F.col("code").alias("shorter"), F.col("p").alias("low")), "shorter")
        p = (F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * F.col("low")) / F.col("total")
        low = written(level.select("code", p.alias("p")), "shared_grams")
    classes = counts.withColumn("context", context)
    sums = classes.groupBy("context").agg(*[x for c in ("toxic", "ordinary") for x in (F.sum(c).alias(f"{c}_total"), F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(f"{c}_free"))])
    both = classes.join(sums, "context").join(low, "code")
    p = {c: (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + (THETA + F.col(f"{c}_free")) * F.col("p")) / (F.col(f"{c}_total") + THETA) for c in ("toxic", "ordinary")}
    return both.select("code", F.round(F.log(p["toxic"] / p["ordinary"]) * SCALE).cast("int").alias("weight"))


def _best(codes: np.ndarray, ends: np.ndarray, new: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights of each text's best stretch; 0 for a text without grams."""
    if not len(codes) or not len(known):
        return np.zeros(len(ends), np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    sums = np.append(0, np.cumsum(np.where((known[at] == codes) & new, weights[at], 0), dtype=np.int64))
    sizes = np.diff(ends, prepend=0)
    starts = np.repeat(ends - sizes, sizes)
    stops = np.arange(1, len(codes) + 1)
    # Stretches of full length; a shorter text is one stretch.
    full = np.minimum(WINDOW, np.repeat(sizes, sizes))
    value = sums[stops] - sums[np.maximum(stops - WINDOW, starts)]
    value[stops - starts < full] = np.iinfo(np.int64).min
    some = sizes > 0
    best = np.zeros(len(ends), np.int64)
    best[some] = np.maximum.reduceat(value, (ends - sizes)[some])
    return best


def differences(docs: DataFrame, weights: DataFrame, keys: list[str], text: str = "text", limit: int | None = None) -> DataFrame:
    """``keys`` and ``best``, the best stretch's sum of weights, of every row. ``weights`` is a written table."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "best long"])
    rows = docs.select(*keys, F.col(text))

    def scored(part: pa.RecordBatch, known: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in part.column(len(keys)).to_pylist()]
        best = _best(*first_grams(texts), known, values)
        return pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(best)], [*keys, "best"])

    if weights.count() * 12 <= (common.BROADCAST_BYTES if limit is None else limit):
        table = weights.toArrow().sort_by("code")  # BROADCAST_BYTES at most
        shared = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "weight")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, len(keys)):
                    yield scored(part, *shared.value)

        return rows.mapInArrow(run, schema)

    # Chunks of texts meet the weights of their grams.
    chunk = common.fresh(rows, "chunk")
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    mixed = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.xxhash64(text))
    rows = rows.select(F.pmod(mixed, F.lit(1 + size // CHUNK_BYTES)).alias(chunk), *keys, text)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keys) + 1):
                found, ends = grams([(t or "").encode() for t in part.column(len(keys) + 1).to_pylist()])
                of = np.repeat(part.column(0).to_numpy(), np.diff(ends, prepend=0))
                order = np.lexsort((found, of))
                of, found = of[order], found[order]
                one = np.ones(len(of), bool)
                one[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(of[one], pa.int64()), pa.array(found[one], pa.int64())], ["chunk", "code"])

    own = rows.mapInArrow(codes, "chunk long, code long").distinct().join(weights, "code").select("chunk", "code", "weight")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        known, values = right.column("code").to_numpy(), right.column("weight").to_numpy()
        texts = left.select(list(range(1, left.num_columns))).to_batches()
        done = [scored(part, known, values) for batch in texts for part in slices(batch, len(keys))]
        return pa.Table.from_batches(done) if done else pa.table({**{k: left.column(k).slice(0, 0) for k in keys}, "best": pa.array([], pa.int64())})

    return rows.groupBy(chunk).cogroup(own.groupBy("chunk")).applyInArrow(meet, schema)


def _mean(best: Column) -> Column:
    """The length-normalised difference."""
    return best / F.lit(float(SCALE * WINDOW))


def fit_curve(steps: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(start, slope) of the logistic curve through (step, texts, toxic texts), by Newton's method under a normal prior."""
    x, n, bad = (np.array(v, float) for v in zip(*steps, strict=True)) if steps else (np.zeros(1),) * 3
    x = np.stack([np.ones_like(x), x / STEPS], 1)
    mean, precision = np.array([PRIOR[0], SLOPE]), np.diag(PRIOR[1:])
    at = mean.copy()
    # The logarithm of a posterior that is concave: halved steps always lead up.
    value = lambda b: float((bad * (x @ b) - n * np.logaddexp(0, x @ b)).sum() - (b - mean) @ precision @ (b - mean) / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -700, 700)))
        slope = x.T @ (bad - n * p) - precision @ (at - mean)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + precision, slope)
        while value(at + step) < value(at) and np.abs(step).max() > 1e-9:
            step /= 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), max(float(at[1]), 0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int | None = None) -> tuple[DataFrame, tuple[float, float]]:
    """The weights of all grams and the curve, from the documents that ``labels`` names."""
    chosen = labelled(docs, labels, key, text, label)
    seen = docs.select(F.col(key), F.col(text)).join(broadcast_if_small(chosen, 24), key)
    weights = written(weigh(written(count_grams(seen.where(~F.col("fits")), "toxic", text), "toxic_grams")), "toxic_weights")
    best = differences(seen.where("fits"), weights, ["toxic"], text, limit)
    # Differences lie between those of a few hundred grams' weights, so there are few steps.
    steps = best.groupBy(F.round(_mean(F.col("best")) * STEPS).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    return weights, fit_curve([tuple(r) for r in steps.orderBy("step").collect()])


def score(docs: DataFrame, model: tuple[DataFrame, tuple[float, float]], keys: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int | None = None) -> DataFrame:
    """``keys`` and score, the probability of being toxic, of every row."""
    weights, (start, slope) = model
    best = differences(docs, weights, list(keys), text, limit)
    return best.select(*keys, (1 / (1 + F.exp(-(F.lit(start) + slope * _mean(F.col("best")))))).alias("score"))
