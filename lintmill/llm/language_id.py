"""Language identification by prediction by partial matching.

Each language has a byte context tree of order ORDER. A byte's probability is
taken from the longest context that has been seen with it; every longer context
that was seen without it costs an escape (method C: as many escapes as
different bytes followed). The statistics are frozen after training, so the
code length of a byte depends on itself and the ORDER bytes before it alone,
and a text's code length is an exact sum. The language with the shortest code
wins; the score is its posterior under equal priors.

All training rows are counted and all contexts are kept, as written tables. While
there are at most PAIRS of them they are one model, sent to the tasks. Beyond that texts are
dealt into chunks and each chunk gets, by joins, the costs of those pairs and contexts that
its own bytes can ask for, of every order: the same numbers, so the same result.

Defined cases: a null text and one without a letter are ``und`` with score 0, as
is all text if nothing was learned. Of equal code lengths the first language by
name wins. Rows without a language or text teach nothing. Repeated rows count
and are judged each by itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import fresh, slices, written

ORDER = 4
#: Context-and-byte pairs, over all languages, up to which the model is sent to the tasks.
PAIRS = 3_000_000
#: Bytes of texts in a chunk where it is not.
CHUNK_BYTES = 8 << 20
#: Pairs that a task counts before it passes its sums on.
COUNTED = 4_000_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def contexts(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends): each byte with the ``order`` bytes before it as one number, and the places of each text.

    Zero bytes stand before a text. Places between the texts hold codes that belong to none.
    """
    pad = bytes(order)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)) + pad, np.uint8)
    codes = data[order:].astype(np.int64)
    for back in range(1, order + 1):
        codes |= data[order - back : len(data) - back].astype(np.int64) << 8 * back
    ends = np.cumsum([len(t) + order for t in texts]) - order
    return codes, ends - [len(t) for t in texts], ends


def count_contexts(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, code, n) over all rows; tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(name: str) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip(*parts[name], strict=True))
            unique, place = np.unique(codes, return_inverse=True)
            return unique, np.bincount(place, counts).astype(np.int64)

        def rows_of(name: str, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

        for batch in batches:
            for part in slices(batch, 1):
                by: dict[str, list[bytes]] = {}
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(name, []).append(value.encode())
                for name, texts in by.items():
                    codes, starts, ends = contexts(texts)
                    inside = np.zeros(len(codes) + 1, np.int8)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    found = parts.setdefault(name, [])
                    found.append(np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True))
                    if sum(len(c) for c, _ in found) > COUNTED:
                        found[:] = [merged(name)]
                        if len(found[0][0]) > COUNTED // 2:
                            yield rows_of(name, *found[0])
                            found.clear()
        for name, found in parts.items():
            if found:
                yield rows_of(name, *merged(name))

    chosen = rows.select(F.col(lang).cast("string"), F.col(text))
    return chosen.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Tree:
    """One language's frozen statistics: for each order, the longest first, pairs with their costs and contexts with those of an escape."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.orders = orders

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Tree:
        orders = []
        for order in range(ORDER, -1, -1):
            codes, place = np.unique(codes & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(place, counts, len(codes))
            above, of = np.unique(codes >> 8, return_inverse=True)
            total, kinds = np.bincount(of, counts), np.bincount(of)
            orders.append((codes, -np.log2(counts / (total + kinds)[of]), above, -np.log2(kinds / (total + kinds))))
        return cls(orders)

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each byte after its context."""
        bits, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order, (pairs, costs, above, escapes) in zip(range(ORDER, -1, -1), self.orders, strict=True):
            code = codes[open_] & ((1 << 8 * (order + 1)) - 1)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
                seen = pairs[at] == code
                bits[open_[seen]] += costs[at[seen]]
                open_, code = open_[~seen], code[~seen]
            if not len(above):
                continue
            at = np.minimum(np.searchsorted(above, code >> 8), len(above) - 1)
            known = above[at] == code >> 8
            bits[open_[known]] += escapes[at[known]]
        bits[open_] += 8.0
        return bits


class Model:
    """The trees of all languages, and the code lengths of every pair that some tree has seen."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[name] for name in self.langs]
        seen = [t.orders[0][0] for t in self.trees]
        self.known = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        self.table = np.array([t.lengths(self.known) for t in self.trees], np.float32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        codes, starts, ends = contexts(texts)
        places, unique = pd.factorize(codes)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        edges = np.stack([starts, ends], 1).ravel()
        out = np.empty((len(texts), len(self.langs)))
        for column, tree in enumerate(self.trees):
            bits = self.table[column][at].astype(np.float64) if len(self.known) else np.empty(len(unique))
            bits[new] = tree.lengths(unique[new])
            out[:, column] = np.add.reduceat(np.append(bits[places], 0.0), edges)[::2]
        out[starts == ends] = 0.0
        return out


class Statistics:
    """What was learned: (lang, code, n) of all pairs, a written table; and the languages."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())

    def model(self) -> Model:
        """The whole model, on the driver: for at most PAIRS pairs."""
        frame = self.counts.toArrow().to_pandas()
        return Model({name: Tree.of(g["code"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for name, g in frame.groupby("lang")})

    def costs(self) -> DataFrame:
        """(order, escape, lang, code, cost): of each order's pairs, and of an escape from each of its contexts."""
        parts = []
        for order in range(ORDER, -1, -1):
            code = F.col("code").bitwiseAND((1 << 8 * (order + 1)) - 1)
            pairs = self.counts.groupBy("lang", code.alias("code")).agg(F.sum("n").alias("n"))
            pairs = written(pairs.withColumn("above", F.shiftright("code", 8)), "ppm_pairs")
            sums = written(pairs.groupBy("lang", "above").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "ppm_contexts")
            free = F.col("total") + F.col("kinds")
            both = pairs.join(sums, ["lang", "above"])
            parts.append(both.select(F.lit(order).alias("order"), F.lit(False).alias("escape"), "lang", "code", F.col("n").cast("double").alias("part"), free.alias("whole")))
            parts.append(sums.select(F.lit(order).alias("order"), F.lit(True).alias("escape"), "lang", F.col("above").alias("code"), F.col("kinds").cast("double").alias("part"), free.alias("whole")))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return written(every, "ppm_costs")


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> Statistics:
    """The statistics of all rows with a language and a text."""
    return Statistics(written(count_contexts(rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang, text), "ppm_counts"))


def _judge(model: Model, part: pa.RecordBatch, keys: tuple[str, ...]) -> pa.RecordBatch:
    texts = part.column(len(keys)).to_pylist()
    worth = [i for i, t in enumerate(texts) if t and model.langs and any(map(str.isalpha, t))]
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if worth:
        bits = model.code_lengths([texts[i].encode() for i in worth])
        best = bits.argmin(1)
        posterior = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
        for i, b, p in zip(worth, best.tolist(), posterior.tolist(), strict=True):
            names[i], scores[i] = model.langs[b], p
    arrays = [*part.columns[: len(keys)], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, [*keys, "lang_pred", "score"])


def identify(docs: DataFrame, learned: Statistics, text: str = "text", keys: tuple[str, ...] = ("doc_id",), pairs: int = PAIRS) -> DataFrame:
    """``keys``, lang_pred and score of every row."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "lang_pred string, score double"])
    rows = docs.select(*keys, F.col(text))
    if learned.counts.count() > pairs:
        return _identify_in_chunks(rows, learned, text, keys, schema)
    shared = docs.sparkSession.sparkContext.broadcast(learned.model())  # PAIRS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keys)):
                yield _judge(shared.value, part, keys)

    return rows.mapInArrow(run, schema)


def _identify_in_chunks(rows: DataFrame, learned: Statistics, text: str, keys: tuple[str, ...], schema: str) -> DataFrame:
    langs, chunk = learned.langs, fresh(rows, "chunk")
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    mixed = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.xxhash64(text))
    dealt = rows.select(F.pmod(mixed, F.lit(1 + size // CHUNK_BYTES)).alias(chunk), *keys, text)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a chunk can ask for: its pairs of each order and their contexts."""
        for batch in batches:
            for part in slices(batch, 1):
                numbers = part.column(0).to_numpy()
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                for number in np.unique(numbers):
                    codes, _, _ = contexts([t for t, n in zip(texts, numbers, strict=True) if n == number])
                    for order in range(ORDER, -1, -1):
                        codes = np.unique(codes & ((1 << 8 * (order + 1)) - 1))
                        for escape, found in ((False, codes), (True, np.unique(codes >> 8))):
                            n = len(found)
                            arrays = [pa.array(np.full(n, number)), pa.array(np.full(n, order, np.int32)), pa.array(np.full(n, escape)), pa.array(found)]
                            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "order", "escape", "code"])

    wanted = dealt.select(chunk, text).mapInArrow(asked, "chunk long, order int, escape boolean, code long").distinct()
    own = wanted.join(learned.costs(), ["order", "escape", "code"]).select("chunk", "order", "escape", "lang", "code", "part", "whole")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        frame = right.to_pandas().sort_values("code", kind="stable")
        frame["cost"] = -np.log2(frame["part"].to_numpy(np.float64) / frame["whole"].to_numpy(np.float64))
        by = dict(list(frame.groupby(["lang", "order", "escape"])))
        trees = {}
        for lang in langs:
            orders = []
            for order in range(ORDER, -1, -1):
                sides = [by.get((lang, order, escape)) for escape in (False, True)]
                arrays = [(g["code"].to_numpy(np.int64), g["cost"].to_numpy(np.float64)) if g is not None else (np.empty(0, np.int64), np.empty(0)) for g in sides]
                orders.append((*arrays[0], *arrays[1]))
            trees[lang] = Tree(orders)
        model = Model(trees)
        texts = left.select(list(range(1, left.num_columns))).to_batches()
        done = [_judge(model, part, keys) for batch in texts for part in slices(batch, len(keys))]
        empty = {**{k: left.column(k).slice(0, 0) for k in keys}, "lang_pred": pa.array([], pa.string()), "score": pa.array([], pa.float64())}
        return pa.Table.from_batches(done) if done else pa.table(empty)

    return dealt.groupBy(chunk).cogroup(own.groupBy("chunk")).applyInArrow(meet, schema)
