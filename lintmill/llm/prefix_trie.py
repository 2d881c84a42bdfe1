"""The trie of conversations: every shared beginning, with what it saves.

A conversation is a sequence of turns. Node ``d`` levels below the root stands
for a sequence of ``d`` turns that some conversation starts with.

Prefixes are compared by digests of 127 bits: a turn is a number cut from the
SHA-256 of its role and text, a sequence the value of the polynomial with these
coefficients at BASE, modulo a Mersenne prime. Sequences can be joined and cut by
their digests alone, so texts are read once, where they are scanned, and never
shuffled, and a conversation need not be in one place: turns are sorted into
ranges, each task numbers its own, and a conversation cut by the ends of ranges
is put together from one row for each range.

Most prefixes belong to one conversation only. A count-min sketch of all prefix
digests (two rows of counters that stop at two) never counts too little, so an
estimate of one proves a prefix single, and with it all that follow. Such tails are emitted
where their conversation is, without a look at any other. Only prefixes that
may be shared are shuffled and grouped exactly. The sketch has a fixed largest
size (WIDTH counters a row); in a fuller one more prefixes look shared and are
shuffled, the result stays the same.

Sums over subtrees take as many rounds as the depth has binary digits: after
each, a node knows the sum of twice as many levels and an ancestor twice as far up.

Defined cases: turns are ordered by number, null first, equal numbers by the
digest of role and text; null role or text is empty. Rows without a conversation
id belong to none and are left out. Repeated rows are turns of their own. Empty tables give
an empty result, without a root. Texts of any length are hashed by the scan. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, written

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")
#: Most counters in one row of the sketch, a power of two, and counters for each prefix below that.
WIDTH, ROOMY = 1 << 25, 8
#: Counters of the sketch that are moved as one row.
STRIP = 1 << 16
#: Levels of a tail, and bytes of a list of ids, that one row makes or holds.
LEVELS, IDS = 10_000, 1 << 20
#: The most turns that a conversation takes over from another.
HEAD = 5
NONE = bytes(16)


def _number(value: bytes | None) -> int:
    return int.from_bytes(value or NONE, "big")


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, unit, n): place of a turn in its conversation and the digests before and after it, as far as this range knows."""
    part, conv, place, digest = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        convs, units = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places, before, after = [], [], []
        for c, unit in zip(convs, units, strict=True):
            if c != conv:
                conv, place, digest = c, 0, 0
            before.append(_bytes(digest))
            place, digest = place + 1, (digest * BASE + _number(unit) + 1) % PRIME
            places.append(place)
            after.append(_bytes(digest))
        arrays = [pa.array([part] * len(convs), pa.int32()), batch.column(0), pa.array(places, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "conv", "place", "before", "after", "n"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sequences whose first ``step`` turns (digest ``old``) are replaced by others (digest ``new``).

    Rows are (conv, place, before, after, n, step, old, new, rise): the turn at ``place`` comes to stand ``rise`` further down.
    """
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(9)]
        places, before, after = [], [], []
        power, key = 1, None
        for conv, place, b, a, _, step, old, new, rise in zip(*columns, strict=True):
            power = power * BASE % PRIME if key == (conv, place - 1) else pow(BASE, place - step, PRIME)
            key, change = (conv, place), _number(new) - _number(old)
            before.append(_bytes((_number(b) + change * pow(BASE, place - step - 1, PRIME)) % PRIME) if change else b)
            after.append(_bytes((_number(a) + change * power) % PRIME))
            places.append(place + rise)
        arrays = [batch.column(0), pa.array(places, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column(4)]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "place", "before", "after", "n"])


_MOVED = "conv long, place long, before binary, after binary, n long"


def hash_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, before, after, n): each turn's place, the digests of its conversation without and with it, and its code points."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    unit = F.unhex(F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 30))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), unit.alias("unit"), F.length(said).cast("long").alias("n"))
    order = ["conv", "turn", "unit"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "unit", "n")
    hashed = written(ranged.mapInArrow(_hashed, "part int, " + _MOVED), "hashed_turns")
    # Conversations that go on in the next range; one row for each range.
    ranges = hashed.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi")).orderBy("part").collect()
    cut = sorted({a.hi for a, b in zip(ranges, ranges[1:]) if a.hi == b.lo})
    if not cut:
        return hashed.drop("part")
    spark = turns.sparkSession
    broken = F.broadcast(spark.createDataFrame([(c,) for c in cut], "conv long"))
    ends = hashed.join(broken, "conv", "left_semi").groupBy("conv", "part").agg(F.max("place").alias("size"), F.max_by("after", "place").alias("after"))
    carried, whole = [], {}
    for row in ends.orderBy("part", "conv").collect():
        size, digest = whole.get(row.conv, (0, 0))
        if size:
            carried.append((row.conv, row.part, size, _bytes(digest)))
        whole[row.conv] = (size + row["size"], (digest * pow(BASE, row["size"], PRIME) + _number(row.after)) % PRIME)
    carried = F.broadcast(spark.createDataFrame(carried, "conv long, part int, rise long, new binary"))
    joined = hashed.join(carried, ["conv", "part"], "left")
    step = [F.lit(0).cast("long").alias("step"), F.lit(NONE).alias("old"), F.coalesce("new", F.lit(NONE)).alias("new"), F.coalesce("rise", F.lit(0)).cast("long").alias("rise")]
    return written(joined.select("conv", "place", "before", "after", "n", *step).mapInArrow(_moved, _MOVED), "joined_turns")


def rebuild(turns: DataFrame, taken: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``taken`` turns (HEAD at most) of another, ``base``, and go on with their own after as many.

    ``turns`` is the table of ``hash_turns``; the two columns are expressions of ``conv``.
    Returns (conv, size) of all, and their prefixes (conv, place, before, after, n).
    """
    heads = [F.max(F.when(F.col("place") == i, F.struct("after", "n"))).alias(f"h{i}") for i in range(1, HEAD + 1)]
    convs = written(turns.groupBy("conv").agg(F.max("place").alias("size"), *heads), "conversations")

    def after(side: str, place: Column) -> Column:
        return F.coalesce(*[F.when(place == i, F.col(f"{side}.h{i}.after")) for i in range(1, HEAD + 1)], F.lit(NONE))

    own = convs.select("*", taken.cast("long").alias("taken"), base.alias("base")).alias("own")
    bases = convs.alias("other")
    both = own.join(bases, F.col("own.base") == F.col("other.conv"), "left")
    given, left = F.least("taken", F.coalesce("other.size", F.lit(0))), F.least("taken", "own.size")
    shares = [F.struct(F.lit(i).cast("long").alias("place"), after("other", F.lit(i - 1)).alias("before"), F.col(f"other.h{i}.after").alias("after"), F.col(f"other.h{i}.n").alias("n")) for i in range(1, HEAD + 1)]
    plan = written(
        both.select(
            F.col("own.conv").alias("conv"),
            (given + F.col("own.size") - left).alias("size"),
            F.col("taken"),
            (given - left).alias("rise"),
            left.alias("step"),
            after("own", left).alias("old"),
            after("other", given).alias("new"),
            F.filter(F.array(*shares), lambda s: s["place"] <= given).alias("shares"),
        ),
        "rebuilt",
    )
    begun = plan.select("conv", F.explode("shares").alias("s")).select("conv", "s.*")
    follow = turns.join(plan.select("conv", "step", "old", "new", "rise"), "conv").where(F.col("place") > F.col("step"))
    follow = follow.select("conv", "place", "before", "after", "n", "step", "old", "new", "rise").mapInArrow(_moved, _MOVED)
    return plan.select("conv", "size"), written(begun.unionByName(follow), "prefixes")


def _cells(digests: pa.Array, width: int) -> np.ndarray:
    """A counter in each of the two rows for every digest, the second row behind the first."""
    words = np.frombuffer(b"".join(digests.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.concatenate([words[:, 0] & np.uint64(width - 1), (words[:, 1] & np.uint64(width - 1)) + np.uint64(width)]).astype(np.int64)


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Counters of all digests in ``after``: 0, 1, or 2 for more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(2 * width, np.uint8)
        for batch in batches:
            cells, n = np.unique(_cells(batch.column(0), width), return_counts=True)
            counters[cells] = np.minimum(counters[cells] + np.minimum(n, 2), 2)
        strips = counters.reshape(-1, min(STRIP, width))
        used = np.flatnonzero(strips.any(1))
        packed = [np.packbits(strips[i] > 0).tobytes() + np.packbits(strips[i] > 1).tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed, pa.binary())], ["strip", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in batches:
            for bits in batch.column("bits").to_pylist():
                a, b = np.frombuffer(bits, np.uint8).reshape(2, -1)
                once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([once.tobytes() + twice.tobytes()], pa.binary())], ["strip", "bits"])

    digests = prefixes.select("after")
    # A task sends its whole sketch on, so there are no more of them than run at a time.
    few = digests.coalesce(max(1, digests.sparkSession.sparkContext.defaultParallelism))
    strips = few.mapInArrow(build, "strip long, bits binary").groupBy("strip").applyInArrow(merge, "strip long, bits binary")
    counters = np.zeros((2 * width // min(STRIP, width), min(STRIP, width)), np.uint8)
    for row in strips.toLocalIterator():  # 2 * WIDTH / 4 bytes at most
        once, twice = np.unpackbits(np.frombuffer(row.bits, np.uint8).reshape(2, -1), axis=1)
        counters[row.strip] = once + twice
    return counters.ravel()


def maybe_shared(prefixes: DataFrame, width: int | None = None) -> DataFrame:
    """The prefixes that the sketch does not prove to be of one conversation only."""
    if width is None:
        width = min(WIDTH, max(1 << 12, 1 << (ROOMY * prefixes.count()).bit_length()))
    many = np.packbits(sketch(prefixes, width) > 1)
    shared = prefixes.sparkSession.sparkContext.broadcast(many)  # 2 * WIDTH / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = shared.value
        for batch in batches:
            cells = _cells(batch.column(3), width)
            full = (many[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
            chosen = full.reshape(2, -1).all(0)
            if chosen.any():
                yield batch.filter(pa.array(chosen))

    return prefixes.select("conv", "place", "before", "after", "n").mapInArrow(run, _MOVED)


def ids_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): SHA-256 of each node's ids in order, joined by commas.

    Ranges of the sorted rows are joined to long strings first, so that one task reads a hot node in few rows.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, size, ids = None, 0, 0, []

        def out() -> pa.RecordBatch:
            arrays = [pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])]
            return pa.RecordBatch.from_arrays(arrays, ["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or size > IDS):
                    yield out()
                    size, ids = 0, []
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, ([], [])
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done[0].append(node)
                    done[1].append(state.hexdigest())
                node, state = n, hashlib.sha256(ids.encode())
        if state:
            done[0].append(node)
            done[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["node", "ends_sha256"])

    ranged = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    strings = ranged.mapInArrow(join, "node binary, first long, ids string")
    return strings.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def sum_subtrees(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) of (node, up, leaves, saved), summed over each node and all below it."""
    now = written(nodes.select("node", "up", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "subtrees")
    while not now.where(F.col("up").isNotNull()).isEmpty():
        below = now.where(F.col("up").isNotNull()).groupBy("up").agg(*[F.sum(c).alias(f"more_{c}") for c in ("n_leaves", "saved_tokens")])
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"))
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("n_leaves", "saved_tokens")]
        step = now.join(below.withColumnRenamed("up", "node"), "node", "left").select("node", "up", *sums)
        now = written(step.join(above, "up", "left").select("node", F.col("further").alias("up"), "n_leaves", "saved_tokens"), "subtrees")
    return now.drop("up")


def trie(convs: DataFrame, prefixes: DataFrame, width: int | None = None) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has (conv, size) of every conversation, ``prefixes`` their prefixes (conv, place, before, after, n).
    """
    empty = F.lit(hashlib.sha256().hexdigest())
    candidates = written(maybe_shared(prefixes, width), "maybe_shared")
    grouped = candidates.groupBy(F.col("after").alias("node")).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("place").alias("depth"), F.first("before").alias("up"), F.first("n").alias("n")
    )
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where(F.col("n_convs") > 0)
    root = root.select(F.lit(NONE).alias("node"), "conv", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("n"))
    shared = written(grouped.where(F.col("n_convs") > 1).unionByName(root), "shared_prefixes")

    # Where each conversation leaves the shared part: at the root if nothing else.
    small = broadcast_if_small(shared.select("node", F.col("conv").alias("top_conv"), F.col("depth").alias("top_depth")).where("top_depth > 0"), 64)
    tops = candidates.select("conv", F.col("after").alias("node")).join(small, "node").groupBy("conv").agg(F.max(F.struct("top_depth", "top_conv", "node")).alias("top"))
    first = convs.agg(F.min("conv")).first()[0]
    left = written(
        convs.join(tops, "conv", "left").select(
            "conv", "size", F.coalesce("top.top_depth", F.lit(0)).alias("top_depth"), F.coalesce("top.top_conv", F.lit(first).cast("long")).alias("top_conv"), F.coalesce("top.node", F.lit(NONE)).alias("node")
        ),
        "left_shared",
    )
    tails = left.where(F.col("size") > F.col("top_depth"))
    ends = ids_digests(left.where(F.col("size") == F.col("top_depth")).select("node", "conv"))

    children = shared.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    singles = tails.groupBy("node").agg(F.count(F.lit(1)).alias("singles"))
    nodes = shared.join(children, "node", "left").join(singles, "node", "left").na.fill(0, ["inner", "singles"])
    nodes = nodes.withColumn("n_children", F.col("inner") + F.col("singles"))
    nodes = nodes.withColumn("leaves", F.col("singles") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n"))
    nodes = written(nodes, "shared_nodes")
    parents = shared.select(F.col("node").alias("up"), F.col("conv").alias("parent_conv_id"))
    inner = nodes.join(sum_subtrees(nodes), "node").join(parents, "up", "left").join(ends, "node", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )

    # Long tails are dealt out in stretches, so that a hot conversation is not one task's.
    stretches = F.explode(F.sequence(F.col("top_depth") + 1, F.col("size"), F.lit(LEVELS).cast("long"))).alias("begin")
    long = F.col("size") - F.col("top_depth") > LEVELS
    dealt = tails.where(long).select("conv", "size", "top_depth", "top_conv", stretches).repartition("conv", "begin")
    dealt = dealt.unionByName(tails.where(~long).select("conv", "size", "top_depth", "top_conv", (F.col("top_depth") + 1).alias("begin")))
    levels = dealt.select("*", F.explode(F.sequence("begin", F.least(F.col("begin") + LEVELS - 1, F.col("size")))).alias("depth"))
    last = F.col("depth") == F.col("size")
    outer = levels.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top_depth") + 1, F.col("top_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return inner.unionByName(outer)
