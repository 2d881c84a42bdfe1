"""Byte-level BPE encoding and decoding in overlapping chunks.

A text of up to CHUNK characters is pre-tokenised and encoded in its row. A
longer text is cut into chunks that overlap by OVERLAP characters and are dealt
over the cluster. Every chunk is pre-tokenised from its own start. A scan has no
memory: where two scans begin a pre-token at the same place, they agree from
there on. The first such place in an overlap (not behind white space, whose
matches look ahead) is the seam. The piece between two seams is encoded by its
chunk's task, and the ids are joined in order. A text with an overlap that has
no seam is encoded in one piece. Decoding joins the raw bytes of the ids.

Defined cases: null is encoded as the empty text. Characters of special tokens
are plain text. Repeated rows give repeated results. Ids out of the vocabulary
raise KeyError. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, fresh, key_of, slices, written

CHUNK = 32_768
OVERLAP = 1_024
#: Pre-tokens a task remembers.
REMEMBERED = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _Encoder(dict):
    """Pre-token -> its ids as little-endian int32 bytes, filled on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self.find = regex.compile(pattern)
        self._core = tiktoken.Encoding("ranks", pat_str=r"(?s).", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self._core.encode_single_piece(token.encode()), "<i4").tobytes()
        self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find.findall(text)))


def _id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype="<i4")
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _tokens(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {rank: piece for piece, rank in ranks.items()}


def _bytes_of(lists: pa.ListArray, token: dict[int, bytes]) -> pa.Array:
    """The bytes of each list of ids; null for null."""
    return pa.array([b"".join(map(token.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None for x in lists], pa.binary())


class Bpe:
    """A vocabulary, shipped to the tasks once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap <= chunk:
            raise ValueError("an overlap is at least 1 and at most a chunk")
        # The vocabulary is a fixed file of about a megabyte.
        self.ranks = spark.sparkContext.broadcast(ranks)
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap

    def _map_text(self, df: DataFrame, text: str, keys: list[str], back: bool = False) -> DataFrame:
        """``keys`` and the ids of every row's text; ``back``: and the bytes that the ids stand for."""
        ranks, pattern = self.ranks, self.pattern
        names = [*keys, "ids", *["decoded"] * back]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _Encoder(ranks.value, pattern)
            token = _tokens(ranks.value)
            for batch in batches:
                for part in slices(batch, len(keys)):
                    ids = _id_lists([encoder.encode(t or "") for t in part.column(len(keys)).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], ids, *[_bytes_of(ids, token)] * back], names)

        chosen = df.select(*keys, F.col(text))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
        return chosen.mapInArrow(run, f"{schema}, ids array<int>" + ", decoded binary" * back)

    def _chunks(self, df: DataFrame) -> DataFrame:
        """Chunks of ``df(_key, _text)`` with the places where their scans begin a pre-token inside the overlaps."""
        size, over, pattern = self.chunk, self.overlap, self.pattern

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    starts = range(0, len(text), size)
                    for at in range(0, len(starts), 64):
                        some = starts[at : at + 64]
                        yield pa.RecordBatch.from_pydict(
                            {"_key": [key] * len(some), "chunk": [s // size for s in some], "text": [text[s : s + size + over] for s in some], "last": [s == starts[-1] for s in some]},
                            pa.schema([("_key", pa.string()), ("chunk", pa.int32()), ("text", pa.string()), ("last", pa.bool_())]),
                        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = regex.compile(pattern).finditer
            for batch in batches:
                heads, tails = [], []
                for chunk, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    begins = [m.start() for m in find(text)]
                    safe = [b for b in begins if b and not text[b - 1].isspace()]
                    base = chunk * size
                    heads.append([base + b for b in safe if b < over])
                    tails.append([base + b for b in safe if b >= size])
                places = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *places], [*batch.schema.names, "head", "tail"])

        schema = "_key string, chunk int, text string, last boolean"
        dealt = df.mapInArrow(cut, schema).repartition("_key", "chunk")
        return dealt.mapInArrow(scan, f"{schema}, head array<int>, tail array<int>")

    def _pieces(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (_key, chunk, text) of the pieces between seams, text null where one is missing; and (_key) of the texts that miss one."""
        slim = chunks.select("_key", "chunk", "head")
        before = chunks.select("_key", (F.col("chunk") + 1).alias("chunk"), "tail")
        seams = slim.join(before, ["_key", "chunk"]).select("_key", "chunk", F.array_min(F.array_intersect("head", "tail")).alias("seam"))
        seams = written(seams.distinct(), "bpe_seams")
        starts = seams.withColumnRenamed("seam", "begin")
        ends = seams.select("_key", (F.col("chunk") - 1).alias("chunk"), F.col("seam").alias("end"))
        base = F.col("chunk") * self.chunk
        begin = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("begin") - base)
        length = F.when(F.col("last"), F.length("text")).otherwise(F.col("end") - base) - begin
        joined = chunks.select("_key", "chunk", "text", "last").join(starts, ["_key", "chunk"], "left").join(ends, ["_key", "chunk"], "left")
        broken = seams.where(F.col("seam").isNull()).select("_key").distinct()
        return joined.select("_key", "chunk", F.substr("text", begin + 1, length).alias("text")), broken

    def encode(self, docs: DataFrame, text: str = "text", keys: list[str] | None = None, back: bool = False) -> DataFrame:
        """``keys`` (all other columns by default) and ``ids`` array<int> of every row.

        ``back``: also ``decoded``, the bytes that the ids stand for; short texts
        are then decoded by the worker that has encoded them.
        """
        keys = [c for c in docs.columns if c not in (text, "ids", *["decoded"] * back)] if keys is None else keys
        long = F.coalesce(F.length(F.col(text)) > self.chunk, F.lit(False))
        short = self._map_text(docs.where(~long), text, keys, back)
        # Below, a row of a long text is known by its digest; its other columns wait in ``far``.
        own = fresh(docs, "_key")
        far = docs.where(long).withColumn(own, key_of(*[F.col(k) for k in keys], F.col(text)))
        chunks = written(self._chunks(far.select(F.col(own).alias("_key"), F.col(text).alias("_text"))), "bpe_chunks")
        pieces, broken = self._pieces(chunks)
        broken = broadcast_if_small(written(broken, "bpe_broken"), 48)
        whole = pieces.join(broken, "_key", "left_anti")
        # One text's pieces; the set drops those of repeated rows. The ids are moved here, and once:
        # the other columns come to them, and only texts without a seam are read again.
        whole = self._map_text(whole, "text", ["_key", "chunk"]).groupBy("_key").agg(F.collect_set(F.struct("chunk", "ids")).alias("parts"))
        whole = whole.select(F.col("_key").alias(own), F.flatten(F.sort_array("parts")["ids"]).alias("ids"))
        stitched = whole.join(far.select(*keys, own), own).select(*keys, "ids")
        unseamed = far.join(broken.withColumnRenamed("_key", own), own, "left_semi")
        stitched = self.decode(stitched) if back else stitched
        return short.unionByName(stitched).unionByName(self._map_text(unseamed, text, keys, back))

    def decode(self, encoded: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """The rows with the bytes that their ids stand for."""
        ranks, names = self.ranks, [c for c in encoded.columns if c != to]
        place = names.index(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            token = _tokens(ranks.value)
            for batch in batches:
                for part in slices(batch, place):
                    yield pa.RecordBatch.from_arrays([*part.columns, _bytes_of(part.column(place), token)], [*names, to])

        schema = ", ".join(f"`{c}` {dict(encoded.dtypes)[c]}" for c in names)
        return encoded.select(*names).mapInArrow(run, f"{schema}, `{to}` binary")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
