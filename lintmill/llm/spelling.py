"""Spelling variants: words that are one edit apart, and the commoner form of each.

The sorted vocabulary is a trie in disguise: neighbours share prefixes, and the
lengths of those (LCPs) tell which rows of an edit matrix the next word can
reuse. For at most one edit three cells of a row are enough, one on each
diagonal. A row belongs to a shared prefix, hence to a range of the sorted
list; it is computed once for the range, and a range whose row has no cell
below two is skipped whole.

Spread over a cluster: an edit lies behind the first half of the longer word
or before its second half, so near words share one of the halves. A word enters
the lists of its first half and, written backwards, of its second half, each for
its own length and as the shorter of two. A list has the words of one half; its
scan starts behind that half. A pair is taken from the backward list only where
the forward one does not have it. A list of more than BLOCK words is cut by the
next letter, again and again: its words go to the list of their letter, and each
scan goes on in every list that its row still allows. So lists stay bounded and
no pair is lost.

Defined cases: null and empty texts have no words; a null key counts as the empty
string. Words are compared by code points, ties go to the smallest word. Repeated
rows count as often as they stand. Texts of any length are read in pieces that
end between words. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import slices, written

MIN_LETTERS = 5
MIN_COUNT = 3
#: One run in about so many loses a letter (``h`` divisible by it).
DAMAGE = 97
#: Words of one list; longer lists are cut by their next letter.
BLOCK = 50_000
#: Letters of lists that a task scans at a time, and scans that go on side by side.
CELLS, SCANS = 4_000_000, 20_000
#: Different words that a task counts before it passes its sums on.
COUNTED = 500_000
#: Bytes of one text that are split at a time.
PIECE = 1 << 20

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def runs(key: str, text: str) -> Counter[bytes]:
    """The letter runs of a text, lower-cased and some of them damaged, with their numbers."""
    found: Counter[bytes] = Counter()
    head = zlib.crc32(f"{key}:".encode())
    for piece in _pieces(text.encode().lower()):
        for run, n in Counter(RUN.findall(piece)).items():
            h = zlib.crc32(run, head)
            if h % DAMAGE == 0:
                letters = run.decode()
                at = h % len(letters)
                run = (letters[:at] + letters[at + 1 :]).encode()
            found[run] += n
    return found


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words with letters and occurrences enough; tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            # Two bytes of UTF-8 make one letter here, the first of them always the same.
            kept = {w: n for w, n in counts.items() if len(w) - w.count(b"\xc3") >= MIN_LETTERS}
            words = pa.array(kept.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(kept.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 1):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if t:
                        counts.update(runs(k, t))
                    if len(counts) > COUNTED:
                        yield out()
                        counts.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _letters(word: Column) -> Column:
    """One byte a letter; all letters are below U+0100."""
    return F.encode(word, "ISO-8859-1")


def _lists(words: DataFrame) -> DataFrame:
    """(side, m, depth, stem, letters, n): each word in the lists of its halves, for longer words of m letters."""
    size = F.length("word")
    entries = [
        F.struct(F.lit(side).alias("side"), m.alias("m"), half.cast("int").alias("depth"), (F.col("word") if side == 0 else F.reverse("word")).alias("w"))
        for m in (size, size + 1)
        for side, half in ((0, F.floor(m / 2)), (1, m - F.floor(m / 2)))
    ]
    spread = words.select("n", F.explode(F.array(*entries)).alias("e"))
    letters = _letters(F.col("e.w"))
    return spread.select("e.side", "e.m", "e.depth", letters.substr(F.lit(1), F.col("e.depth")).alias("stem"), letters.alias("letters"), "n")


def _step(lists: DataFrame, scans: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists and scans of the hot stems, one letter further."""
    at = ["side", "m", "depth", "stem"]
    here = F.col("letters").substr(F.col("depth") + 1, F.lit(1))
    ended = F.octet_length("next") == 0
    lists = lists.join(hot, at).withColumn("next", here)
    letters = lists.select(*at, "next").distinct()
    deeper = F.col("depth") + F.when(ended, 0).otherwise(1)
    stem = F.concat("stem", "next")
    lists = lists.select("side", "m", deeper.alias("depth"), stem.alias("stem"), "letters", "n")
    # The next row of the band: diagonals -1, 0, 1.
    size, row, old = F.octet_length("letters"), [], [F.col(f"b{i}") for i in range(3)]
    for i in range(3):
        other = (F.col("letters").substr(F.col("depth") + F.lit(i), F.lit(1)) != F.col("next")).cast("int")
        ways = [old[i] + other, *([old[i + 1] + 1] if i < 2 else []), *([row[-1] + 1] if i else [])]
        best = F.least(*ways, F.lit(2)) if len(ways) > 1 else F.least(ways[0], F.lit(2))
        row.append(F.when(F.col("depth") + i > size, F.lit(2)).otherwise(best))
    moved = scans.join(letters, at).select(
        "side", "m", deeper.alias("depth"), stem.alias("stem"), "letters", *[F.when(ended, o).otherwise(r).alias(f"b{i}") for i, (o, r) in enumerate(zip(old, row, strict=True))]
    )
    return lists, moved.where(F.least("b0", "b1", "b2") <= 1)


class _Rows:
    """Byte strings as a matrix, padded with zeros."""

    def __init__(self, column: pa.Array):
        column = pa.concat_arrays([column]).cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        self.size = np.diff(offsets).astype(np.int64)
        width = int(self.size.max(initial=0)) + 3
        self.at = np.zeros((len(column), width), np.uint8)
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
        self.at[np.arange(width) < self.size[:, None]] = flat

    def letter(self, rows: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        return self.at[rows, np.minimum(place, self.at.shape[1] - 1)]


def _scan(words: _Rows, lcp: np.ndarray, asked: _Rows, who: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asked, word) pairs exactly one edit apart.

    Each scan (``who`` of ``asked``) is at a range [lo, hi) of the sorted words with
    a shared prefix of ``depth`` letters, with the matrix row of that prefix.
    """
    found, state = [], (who[:0], lo[:0], hi[:0], band[:0])
    for p in range(int(depth.min(initial=0)), words.at.shape[1]):
        new = depth == p
        who_, lo_, hi_, band_ = (np.concatenate([a, b[new]]) for a, b in zip(state, (who, lo, hi, band), strict=True))
        if not len(who_) and not (depth > p).any():
            break
        # The ranges of the next letter: the list is cut where a word shares no more than p letters with the one before.
        cuts = np.flatnonzero(lcp <= p)
        first, last = np.searchsorted(cuts, lo_, "right"), np.searchsorted(cuts, hi_, "left")
        count = last - first + 1
        of = np.repeat(np.arange(len(who_)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        padded = np.append(cuts, 0)
        start = np.where(nth == 0, lo_[of], padded[first[of] + nth - 1])
        end = np.where(nth == count[of] - 1, hi_[of], padded[np.minimum(first[of] + nth, len(cuts))])
        q, old = who_[of], band_[of]
        letter, over = words.letter(start, p), asked.size[q] - p
        # A word that ends here is compared with the whole of the other one.
        done = (letter == 0) & (np.abs(over) <= 1)
        at = np.flatnonzero(done)
        hit = at[old[at, over[at] + 1] == 1]
        found.append((q[hit], start[hit]))
        go = letter != 0
        q, old, letter, start, end, over = q[go], old[go], letter[go], start[go], end[go], over[go]
        row = np.empty_like(old)
        for i in range(3):
            row[:, i] = old[:, i] + (asked.letter(q, p + i - 1) != letter)
            if i < 2:
                np.minimum(row[:, i], old[:, i + 1] + 1, out=row[:, i])
            if i:
                np.minimum(row[:, i], row[:, i - 1] + 1, out=row[:, i])
            row[:, i][over < i] = 2
        live = row.min(1) <= 1 if len(row) else np.empty(0, bool)
        state = (q[live], start[live], end[live], np.minimum(row[live], 2))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (who[:0], who[:0])


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of whole lists: rows of (side, m, depth, stem, role, letters, n, b0, b1, b2) in order."""
    side, m, depth, role = (table.column(i).to_numpy() for i in (0, 1, 2, 4))
    stems = table.column(3).combine_chunks()
    stems = stems if isinstance(stems, pa.Array) else pa.concat_arrays(stems.chunks)
    codes = stems.dictionary_encode().indices.to_numpy()
    change = np.ones(len(side), bool)
    change[1:] = (side[1:] != side[:-1]) | (m[1:] != m[:-1]) | (depth[1:] != depth[:-1]) | (codes[1:] != codes[:-1])
    group = np.cumsum(change) - 1
    listed, asking = np.flatnonzero(role < 2), np.flatnonzero(role != 1)
    sizes = np.bincount(group[listed], minlength=group[-1] + 1)
    # A list of one word has a pair only if another one's scan came here.
    asking = asking[(sizes[group[asking]] > 1) | ((role[asking] == 2) & (sizes[group[asking]] > 0))]
    if not len(asking):
        return
    column = table.column(5).combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    words, asked = _Rows(column.take(pa.array(listed))), _Rows(column.take(pa.array(asking)))
    lcp = np.zeros(len(listed), np.int64)
    if len(listed) > 1:
        same = words.at[1:] == words.at[:-1]
        lcp[1:] = np.where(same.all(1), same.shape[1], same.argmin(1))
    starts = np.cumsum(sizes) - sizes
    lcp[starts[sizes > 0]] = -1
    lo, hi = starts[group[asking]], (starts + sizes)[group[asking]]
    band = np.stack([table.column(i).to_numpy()[asking] for i in (7, 8, 9)], 1).astype(np.int8)
    counts = table.column(6).to_numpy()[listed]
    for at in range(0, len(asking), SCANS):
        who = np.arange(at, min(at + SCANS, len(asking)))
        q, w = _scan(words, lcp, asked, who, lo[who], hi[who], depth[asking[who]].astype(np.int64), band[who])
        longest = m[asking[q]]
        keep = np.maximum(asked.size[q], words.size[w]) == longest
        # Backwards, only pairs that differ in the first half of the longer word.
        half, equal = np.where(side[asking[q]] == 1, longest // 2, 0), np.ones(len(q), bool)
        for t in range(int(half.max(initial=0))):
            inside = t < half
            same = asked.letter(q, np.maximum(asked.size[q] - 1 - t, 0)) == words.letter(w, np.maximum(words.size[w] - 1 - t, 0))
            equal &= ~inside | same
        keep &= (half == 0) | ~equal
        q, w = q[keep], w[keep]
        back = side[asking[q]] == 1
        arrays = [column.take(pa.array(asking[q])), pa.array(back), column.take(pa.array(listed[w])), pa.array(counts[w])]
        yield pa.RecordBatch.from_arrays(arrays, ["letters", "back", "near", "n"])


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans runs of whole lists, as many at a time as CELLS allows."""
    held: list[pa.RecordBatch] = []
    cells, last = 0, None
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(4)]
        sizes = [len(x) for x in batch.column(5).to_pylist()]
        begin = 0
        for i, name in enumerate(zip(*names, strict=True)):
            # Rows of one list stay together; a matrix is as wide as its longest word.
            if last is not None and name != last and (cells > CELLS or name[1] != last[1]):
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield from _pairs(pa.Table.from_batches(held))
                held, cells, begin = [], 0, i
            cells, last = cells + sizes[i], name
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield from _pairs(pa.Table.from_batches(held))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, n): all pairs of (word, n) exactly one edit apart, both ways; n is that of ``near``.

    ``words`` should be a written table of different words.
    """
    at = ["side", "m", "depth", "stem"]
    none, band = F.lit(None).cast("int"), [F.lit(x).alias(f"b{i}") for i, x in enumerate((1, 0, 1))]
    lists, parts, scans = _lists(words), [], None
    while True:
        sizes = lists.groupBy(*at).agg(F.count(F.lit(1)).alias("size"))
        hot = written(sizes.where((F.col("size") > block) & (F.col("depth") < F.col("m"))).select(*at), "hot_lists")
        some = not hot.isEmpty()
        rest = lists.join(hot, at, "left_anti") if some else lists
        if scans is None:
            parts.append(rest.select(*at, F.lit(0).alias("role"), "letters", "n", *band))
            scans = lists.select(*at, "letters", *band)
        else:
            others = scans.join(hot, at, "left_anti") if some else scans
            parts.append(rest.select(*at, F.lit(1).alias("role"), "letters", "n", *[none.alias(f"b{i}") for i in range(3)]))
            parts.append(others.select(*at, F.lit(2).alias("role"), "letters", F.lit(None).cast("long").alias("n"), "b0", "b1", "b2"))
        if not some:
            break
        lists, scans = (written(x, "cut_lists") for x in _step(lists, scans, hot))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumns({f"b{i}": F.coalesce(F.col(f"b{i}"), F.lit(0)) for i in range(3)}).withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.select(*at, "role", "letters", "n", "b0", "b1", "b2")
    rows = rows.repartition(*at).sortWithinPartitions("side", "m", "depth", "stem", "letters", "role")
    pairs = rows.mapInArrow(_scan_lists, "letters binary, back boolean, near binary, n long")
    forth = {c: F.decode(F.col(c), "ISO-8859-1") for c in ("letters", "near")}
    return pairs.select(*[F.when(F.col("back"), F.reverse(x)).otherwise(x).alias("word" if c == "letters" else c) for c, x in forth.items()], "n")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles how far a word looks. A form is commoner than its word, so there are no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "spelling_roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = written(count_words(docs, key, text), "spelling_words")
    best = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
    placed = words.join(best, "word", "left")
    taken = -F.col("best.less") >= 2 * F.col("n")
    judged = placed.select(
        "word",
        F.when(taken, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, -F.col("best.less")).cast("long").alias("form_n"),
    )
    judged = written(judged, "spelling_forms")
    roots = follow(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
