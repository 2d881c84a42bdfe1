"""Jaccard join of n-gram sets in a metric space.

Jaccard distance is a metric, but unrelated texts all lie at distance 1, where
pivots can't tell them apart. So the first regions come from projections:

* By size. Linked sets differ in size by the factor ``percent``/100 at most.
  Sizes fall into cells; a set near a cell's upper border also goes into the next.
* By classes. In a cell the n-grams are dealt into more classes than two linked
  sets can differ in, so they agree wholly in the rest of the classes. All sets
  that agree in a class are at distance 0 in that projection: its Voronoi cell,
  and a region. A set goes only into its smallest regions, as many as two linked
  sets can differ in and one more, as then they share one of them: shared phrases
  fill large regions, which no set needs but those that are alike in most classes.

Inside the regions the join is that of metric spaces. The set that most others
agree with is the pivot. Its distance to each set of the region is computed
exactly. What lies within the link distance is linked with the pivot. What is
left, and not yet in one component, splits into rings around the pivot, a link
distance wide; a pair that differs by more can't be linked (triangle
inequality), so each ring with the one before forms a region. ROUNDS rounds of
pivots are run (one, so rings are not split again). What they leave falls into clusters of regions that share
sets; a cluster is dealt into blocks of bounded size, and each pair of blocks is
joined by inverted lists within one task, which gives links but no pairs. Only
components are asked for; no link between different components is lost, and
copies count as one vertex.

N-grams and sets are told apart by 64-bit hashes.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own component. With fewer words than ``n`` the whole sequence
is the only n-gram. Repeated rows are copies. A null id is never the smallest if
there is another. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, fresh, key_of, slices, written
from lintmill.llm.graph import components

N = 4
PERCENT = 85
#: Rounds of pivots before the rest is joined in blocks.
ROUNDS = 1
#: Sets in a block, and n-grams in all of them.
BLOCK, BLOCK_GRAMS = 256, 2 << 20
#: N-grams looked up at a time inside a block.
PIECE = 1 << 14
#: Words that a task remembers the hash of.
REMEMBERED = 500_000

def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def ngrams(text: str | None, n: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words, A-Z in lower case."""
    # bytes.lower and bytes.split know ASCII letters and white space only, as wanted.
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(ids))
    total = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mix(ids[i : len(ids) - width + 1 + i])
    return np.unique(_mix(total))


def vertex(grams: np.ndarray) -> int:
    """A hash of the set."""
    parts = [len(grams), int(grams.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(grams))]
    return xxhash.xxh3_64_intdigest(b"".join(p.to_bytes(8, "little") for p in parts))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Cells:
    """Cells of set sizes and the number of classes in each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 3 // 2))
        return int(np.searchsorted(self.tops, size))

    def regions(self, size: int) -> list[tuple[int, int, int]]:
        """(cell, classes, regions needed) for each cell that a set of this size goes to."""
        out, more = [], self.of(size * 100 // self.percent)
        for cell in range(self.of(size), more + 1):
            # |x - y| + |y - x| <= (|x| + |y|)(100 - p) / (100 + p) for linked sets.
            top = self.tops[cell]
            differ = 2 * top * (100 - self.percent) // (100 + self.percent)
            own = (size + min(top, size * 100 // self.percent)) * (100 - self.percent) // (100 + self.percent)
            out.append((cell, differ + 1 + (differ + 2) // 3, own + 1))
        return out


def signatures(grams: np.ndarray, cells: Cells) -> list[tuple[int, np.ndarray]]:
    """(regions needed, a hash of each class of the set) for each of its cells."""
    low, high, out = (grams & np.uint64(0xFFFFFFFF)).astype(float), (grams >> np.uint64(32)).astype(float), []
    for cell, classes, need in cells.regions(len(grams)):
        dealt = (_mix(grams + np.uint64(1)) % np.uint64(classes)).astype(np.int64)
        # Sums below 2**53 are exact.
        sums = [np.bincount(dealt, half, classes).astype(np.uint64) for half in (low, high)]
        place = np.arange(classes, dtype=np.uint64) + np.uint64(cell << 40)
        out.append((need, _mix(_mix(_mix(place) + sums[0]) + sums[1])))
    return out


def sketch(docs: DataFrame, text: str, keys: tuple[str, ...], n: int, percent: int) -> DataFrame:
    """``keys``, key, size and v of every row (``own``), with the signatures of its first cell; further rows for further cells.

    A task gives the signatures of a set once.
    """
    chosen = docs.select(*keys, key_of(*[F.col(k) for k in keys], F.col(text)).alias("_key"), F.col(text).alias("_text"))
    width = len(keys) + 1
    names = [*keys, "_key", "size", "v", "own", "need", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells, seen = _Hashes(), Cells(percent), set()
        none = np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, width):
                rows, facts, arrays = [], [], []  # row of the slice; size, v, own, need; signatures
                for row, value in enumerate(part.column(width).to_pylist()):
                    grams = ngrams(value, n, hashes)
                    v, found = None, [(0, none)]
                    if len(grams):
                        v = signed(vertex(grams))
                        if v not in seen:
                            seen.add(v)
                            found = signatures(grams, cells)
                    for place, (need, sigs) in enumerate(found):
                        rows.append(row)
                        facts.append((len(grams), v, place == 0, need))
                        arrays.append(sigs)
                ends = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *arrays]).view(np.int64)))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32())
                columns = [pa.array([f[i] for f in facts], kind) for i, kind in enumerate(kinds)]
                taken = [c.take(pa.array(rows, pa.int32())) for c in part.columns[:width]]
                yield pa.RecordBatch.from_arrays([*taken, *columns, lists], names)

    types = dict(docs.dtypes)
    return chosen.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_key string, size long, v long, own boolean, need int, sigs array<long>"]))


def candidate_regions(sketched: DataFrame) -> DataFrame:
    """(region, v, size): each set's smallest regions, as far as it needs them and shares them."""
    every = sketched.where(F.size("sigs") > 0).select("v", "size", "need", F.size("sigs").alias("all"), F.explode("sigs").alias("region"))
    # Nearly all signatures belong to one set: count first, then move only the others.
    shared = written(every.groupBy("region").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared_signatures")
    met = every.join(shared, "region").repartition("v").dropDuplicates(["v", "region"])
    cell = Window.partitionBy("v", "all")
    ranked = met.withColumn("met", F.count(F.lit(1)).over(cell)).withColumn("rank", F.row_number().over(cell.orderBy("rows", "region")))
    # Regions of its own come first in a set's order; they join it with nothing.
    return ranked.where(F.col("rank") <= F.col("need") - (F.col("all") - F.col("met"))).select("region", "v", "size")


def sets_of(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(v, grams): the sets as binary arrays of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, 0):
                grams = [ngrams(t, n, hashes) for t in part.column(0).to_pylist()]
                grams = [g for g in grams if len(g)]
                yield pa.RecordBatch.from_arrays([pa.array([signed(vertex(g)) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], ["v", "grams"])

    return docs.select(F.col(text)).mapInArrow(run, "v long, grams binary")


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the size of the intersection."""
    left = pairs.join(sets.select(F.col("v").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("v").alias("b"), F.col("grams").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared.append(int((y[at] == x).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], ["a", "b", "shared"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long")


def _linkable(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _without_twins(regions: DataFrame) -> DataFrame:
    """Of regions with the same vertices, one."""
    h = F.xxhash64("v")
    marks = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    marks = marks.where("n > 1").groupBy("n", "x", "s").agg(F.min("region").alias("region"))
    return regions.join(written(marks.select("region"), "regions"), "region", "left_semi")


def _mixed(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """The regions whose vertices aren't all in one component; with the component."""
    named = regions.drop("root").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = written(named, "named_regions")
    open_ = named.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("region")
    return _without_twins(named.join(written(open_, "open_regions"), "region", "left_semi"))


def links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Enough links (a, b) to join all that is linked; ``regions(region, v, size)``."""
    found = regions.select(F.col("v").alias("a"), F.col("v").alias("b")).where(F.lit(False))
    step = (100 - percent) / 100 * (1 + 1e-9)  # a hair wider, against rounding at the borders
    regions = written(_without_twins(regions.withColumn("root", F.col("v"))), "regions")
    for turn in range(ROUNDS):
        if regions.isEmpty():
            return found
        # The pivot is the set that meets most others.
        n = written(regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region_sizes")
        met = written(regions.join(n, "region").groupBy("v").agg(F.sum("n").alias("met")), "met")
        best = regions.join(met, "v").groupBy("region").agg(F.max(F.struct("met", "v", "size", "root")).alias("p"))
        pivots = written(best.select("region", F.col("p.v").alias("pivot"), F.col("p.size").alias("p_size"), F.col("p.root").alias("p_root")), "pivots")
        around = regions.join(pivots, "region").where(F.col("v") != F.col("pivot"))
        pairs = around.where(_linkable(F.col("size"), F.col("p_size"), percent) | (F.col("root") == F.col("p_root")))
        pairs = written(pairs.select(F.col("v").alias("a"), F.col("pivot").alias("b"), F.col("size").alias("a_size"), F.col("p_size").alias("b_size")).distinct(), "pairs")
        near = written(common(pairs.select("a", "b"), sets), "shared").join(pairs, ["a", "b"])
        union = F.col("a_size") + F.col("b_size") - F.col("shared")
        near = written(near.select("a", "b", (1 - F.col("shared") / union).alias("far"), (100 * F.col("shared") >= percent * union).alias("linked")), "near")
        found = found.unionByName(near.where("linked").select("a", "b"))
        roots = written(components(found), "roots")
        placed = around.join(near.select(F.col("a").alias("v"), F.col("b").alias("pivot"), "far"), ["v", "pivot"], "left")
        # Sets that are too far from the pivot to be compared lie beyond the link distance: any ring from the second on.
        ring = F.floor(F.col("far") / step)
        rings = F.when(F.col("far").isNull(), F.sequence(F.lit(1), F.lit(int(1 / step) + 2))).otherwise(F.array(ring, ring + 1))
        split = placed.select("region", "v", "size", F.explode(rings).alias("ring"))
        split = split.select(F.xxhash64("region", "ring", F.lit(turn)).alias("region"), "v", "size").distinct()
        regions = written(_mixed(split, roots), "split_regions")
    return found.unionByName(_block_links(regions, sets, percent))


def _block_links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components (``root``) that share a region."""
    low = written(regions.groupBy("region").agg(F.min("v").alias("low")), "region_lows")
    clusters = components(regions.join(low, "region").select(F.col("v").alias("a"), F.col("low").alias("b")))
    members = regions.select("v", "root", "size").distinct().join(clusters.withColumnRenamed("root", "cluster"), "v")
    members = written(members, "cluster_members")
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = members.join(written(size, "cluster_sizes"), "cluster").withColumn("own", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    # A set meets every block of its cluster: its own among them, where it meets its own block.
    each = dealt.select("cluster", "v", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "root")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, first, second = (k.as_py() for k in key)
        own = table["own"].to_numpy()
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table["grams"].combine_chunks()]
        v, root = table["v"].to_numpy(), table["root"].to_numpy()
        found = _links_between(np.flatnonzero(own == first), np.flatnonzero(own == second), grams, root, percent)
        return pa.table({"a": pa.array([v[x] for x, _ in found], pa.int64()), "b": pa.array([v[y] for _, y in found], pa.int64())})

    return each.join(sets, "v").groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def _links_between(left: np.ndarray, right: np.ndarray, grams: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A link for each two components of the sets in ``left`` and ``right`` that it joins."""
    if not len(left) or not len(right):
        return []
    parent = {r: r for r in root.tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    lengths = np.array([len(grams[y]) for y in right])
    tokens, owner = np.concatenate([grams[y] for y in right]), np.repeat(np.arange(len(right)), lengths)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    found = []
    for x in left.tolist():
        shared = np.zeros(len(right), np.int64)
        for at in range(0, len(grams[x]), PIECE):
            piece = grams[x][at : at + PIECE]
            low, high = np.searchsorted(tokens, piece, "left"), np.searchsorted(tokens, piece, "right")
            count = high - low
            places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared += np.bincount(owner[places], minlength=len(right))
        close = np.flatnonzero((100 * shared >= percent * (len(grams[x]) + lengths - shared)) & (root[right] != root[x]))
        for y in right[close].tolist():
            a, b = find(root[x].item()), find(root[y].item())
            if a != b:
                parent[a] = b
                found.append((x, y))
    return found


def join_components(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), n: int = N, percent: int = PERCENT) -> DataFrame:
    """``keys``, key (of keys and text), n_shingles, component_id and root of every row.

    The first key is the id. ``root`` names the component where ids repeat or are null; it is null for an empty set.
    """
    sketched = written(sketch(docs, text, keys, n, percent), "sketches")
    regions = written(candidate_regions(sketched), "candidates")
    # Of the rows with one set, one gives its n-grams; a row that stands in the table more than once is taken once.
    rows = sketched.where("own and v is not null").groupBy("v", "_key").agg((F.count(F.lit(1)) > 1).alias("again"))
    rows = rows.groupBy("v").agg(F.min(F.struct("_key", "again")).alias("r")).join(regions.select("v").distinct(), "v", "left_semi")
    rows = broadcast_if_small(written(rows.select("r.*"), "set_rows"), 72)
    keyed = docs.select(key_of(*[F.col(k) for k in keys], F.col(text)).alias("_key"), F.col(text).alias("_text")).join(rows, "_key")
    keyed = keyed.where("not again").select("_key", "_text").unionByName(keyed.where("again").select("_key", "_text").dropDuplicates(["_key"]))
    sets = written(sets_of(keyed.select("_text"), "_text", n), "sets")
    roots = written(components(links(regions, sets, percent)), "all_roots")
    slim = sketched.where("own").select(*keys, "_key", "size", "v")
    named = slim.join(broadcast_if_small(roots, 32), "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = written(named.drop("v"), "named")
    ident = keys[0]
    least = named.where("root is not null").groupBy("root").agg(F.min(ident).alias("_least"), F.count(F.lit(1)).alias("rows"))
    least = broadcast_if_small(written(least.where("rows > 1").drop("rows"), "smallest_ids"), 64)
    joined = named.join(least, "root", "left")
    return joined.select(*keys, F.col("_key").alias("key"), F.col("size").alias("n_shingles"), F.coalesce("_least", ident).alias("component_id"), "root")


def keep_one(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), **how: int) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for.

    The row with the smallest id stays (of equal ids that with the smallest digest).
    """
    found = written(join_components(docs, text, keys, **how).where("n_shingles > 0"), "components")
    first = F.struct(F.col(keys[0]).isNull().alias("null"), F.col(keys[0]).alias("id"), F.col("key").alias("key"))
    stays = found.groupBy("root").agg(F.min(first)["key"].alias("key"))
    stays = written(stays, "stays")
    own, key, gone = fresh(docs, "_own"), fresh(docs, "_key"), fresh(docs, "_lost")
    lost = found.select("key").distinct().join(stays.select("key"), "key", "left_anti").select(F.col("key").alias(key), F.lit(True).alias(gone))
    again = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(stays.select("key"), "key", "left_semi")
    marks = written(lost.unionByName(again.select(F.col("key").alias(key), F.lit(False).alias(gone))), "join_marks")
    marks = broadcast_if_small(marks, 80)
    placed = docs.withColumn(own, key_of(*[F.col(k) for k in keys], F.col(text))).join(marks, F.col(own) == F.col(key), "left")
    once = placed.where(F.col(gone).isNull()).select(*docs.columns)
    twice = placed.where(~F.col(gone)).dropDuplicates([own]).select(*docs.columns)
    return once.unionByName(twice)
