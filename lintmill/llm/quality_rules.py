"""Quality rules with host verdicts. [native]

Rules are computed inside the row. Failures are then summed by source, each
source's failure rate is shrunk with an empirical beta prior (its mean and
weight are estimated from all sources), and documents of a source whose rate is
surely high are dropped with it.

Defined cases: a null text has no words and fails the base rules. A null source
is a source of its own. Repeated rows count, and are judged, each by itself.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, fresh, let, written

SPACE = r"[\x20\x09-\x0D]+"
#: A source is dropped if its posterior failure rate less Z deviations is this high.
MAX_FAILURES = 0.75
Z = 2.33
#: Least and greatest weight, in documents, of the prior.
WEIGHTS = (2.0, 500.0)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Windows are sorted by hash, then by their words, so equal ones are
    neighbours; texts whose window hashes all differ need no sorting.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def cover(order: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            a, b = F.get(order, i), F.get(order, j)
            return (a["h"] == b["h"]) & (a["g"] == b["g"])

        starts = F.array_sort(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
            lambda i: F.get(order, i)["i"],
        ))
        # The words a start adds: three, less those that the one before has covered.
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    def sorted_windows(h: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), gram(i).alias("g"), i.alias("i")))
        return let(F.sort_array(rows), cover)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(sorted_windows(h)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    return let(split_words(text), of_words)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def failed(m: Column) -> Column:
    """Base rules, or a text of symbols, repeated lines or unlikely words."""
    words = F.greatest(m["n_words"], F.lit(1))
    mean_length = m["word_chars"] / words
    return base_failed(m) | (10 * m["n_symbols"] > 3 * m["n_words"]) | (2 * m["n_dup_lines"] > m["n_words"]) | (mean_length < 2) | (mean_length > 20)


def bad_sources(outcomes: DataFrame, source: str, limit: float = MAX_FAILURES, z: float = Z) -> DataFrame:
    """Sources of ``outcomes(source, failed)`` whose shrunk failure rate is surely at least ``limit``.

    The prior is fitted to the sources' rates by moments: mean, and weight
    mean(1-mean)/s - 1, s being their spread beyond what sampling explains.
    """
    by = outcomes.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    by = written(by, "source_failures")
    total = by.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k")).first()
    mean = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.5
    noise = mean * (1 - mean)
    squares = by.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    excess = max(squares - total["k"] * noise, 0.0) / max((total["n"] or 0) - total["k"], 1)
    weight = WEIGHTS[1] if excess <= 0 else min(max(noise / excess - 1, WEIGHTS[0]), WEIGHTS[1])
    alpha = F.col("bad") + F.lit(weight * mean)
    all_ = F.col("n") + F.lit(weight)
    rate = alpha / all_
    surely = rate - z * F.sqrt(rate * (1 - rate) / (all_ + 1))
    return by.where(surely >= limit).select("_source", F.lit(True).alias("_bad"))


def with_verdicts(measured: DataFrame, source: str, m: str) -> tuple[DataFrame, Column]:
    """``measured`` joined with its sources' verdicts, and whether a row is kept; ``m`` names its struct of measures."""
    outcomes = measured.select(F.col(source).alias("source"), failed(F.col(m)).alias("failed"))
    bad = written(bad_sources(outcomes, "source"), "bad_sources")
    name, mark = fresh(measured, "_source"), fresh(measured, "_bad")
    bad = bad.select(F.col("_source").alias(name), F.col("_bad").alias(mark))
    bad = broadcast_if_small(bad, F.coalesce(F.octet_length(name), F.lit(0)) + 32)
    joined = measured.join(bad, F.col(source).eqNullSafe(F.col(name)), "left")
    return joined, ~base_failed(F.col(m)) & F.col(mark).isNull()


def judge_quality(docs: DataFrame, text: str = "text", source: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the five measures, base_failed and kept of every row.

    Texts are read once; the measures, some fifty bytes a row, are written to
    the shared folder and serve both the sums by source and the verdicts.
    """
    slim = docs.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(source).cast("string").alias("src"), measures(F.col(text)).alias("m"))
    judged, kept = with_verdicts(written(slim, "measures"), "src", "m")
    return judged.select(*[F.col(f"k_{k}").alias(k) for k in keys], "m.*", base_failed(F.col("m")).alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns.

    Reads the texts twice instead of joining verdicts to them: first for the
    sums by source, then to filter. No text is shuffled.
    """
    m, src = fresh(docs, "_m"), fresh(docs, "_src")
    judged, kept = with_verdicts(docs.select("*", measures(F.col(text)).alias(m), F.col(source).cast("string").alias(src)), src, m)
    return judged.where(kept).select(*docs.columns)
