"""Listing a corpus before anything in it is opened.

``corpus_listing`` is a Spark data source of paths and sizes. It never goes down
into an ignored folder and opens no file; its tasks walk subtrees side by side.
Filters on the listing, per owner as well, are ordinary Spark operators; ``opened``
then deals the files that are left into partitions of equal bytes and reads them there.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "repository_path string, file_path string, size_bytes long, uri string"
#: Subtrees that the driver finds for the tasks to walk.
SUBTREES = 256
#: Files listed as one batch, and bytes of files that a task holds as one.
LISTED, HELD = 4096, 16 << 20
#: Bytes of files for one task; more for a corpus that would need more tasks than TASKS.
TASK_BYTES, TASKS = 64 << 20, 100_000


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Raises for stores that only Spark can read."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def can_list(uri: str) -> bool:
    try:
        file_system(uri)
    except (pa.ArrowException, OSError):
        return False
    return True


class Subtrees(InputPartition):
    """Folders to walk, and files that stand above them, as (path, size), relative to the root."""

    def __init__(self, folders: list[str], files: list[tuple[str, int]]):
        self.folders, self.files = folders, files


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.depth = int(options.get("repository_depth", "0"))
        self.ignored = set(json.loads(options.get("ignored_folders", "[]")))
        self.endings = tuple(json.loads(options.get("endings", '[""]')))
        self.most = int(options["most"]) if "most" in options else None
        self.repositories: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Takes bounds of the size and names of repositories; leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, (LessThanOrEqual, LessThan)) and f.attribute == ("size_bytes",):
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("repository_path",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repositories = names if self.repositories is None else self.repositories & names
            else:
                yield f

    def _entered(self, path: str) -> bool:
        """Whether a folder may hold files that are asked for."""
        parts = path.split("/")
        if not self.ignored.isdisjoint(parts[self.depth :]):
            return False
        if self.repositories is None:
            return True
        head = parts[: self.depth]
        return any(name.split("/")[: len(head)] == head for name in self.repositories)

    def _listed(self, path: str) -> bool:
        parts = path.split("/")
        name = parts[-1].lower()
        inside = self.repositories is None or "/".join(parts[: self.depth]) in self.repositories
        return len(parts) > self.depth and inside and name.endswith(self.endings) and self.ignored.isdisjoint(parts[self.depth :])

    def _children(self, system: pafs.FileSystem, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        folders, files = [], []
        for entry in system.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"))):
            path = f"{folder}/{entry.base_name}".lstrip("/")
            if entry.type == pafs.FileType.Directory:
                # A link to a folder is not followed; it could lead back here.
                linked = isinstance(system, pafs.LocalFileSystem) and os.path.islink(entry.path)
                if not linked and self._entered(path):
                    folders.append(path)
            elif entry.type == pafs.FileType.File and self._listed(path) and (self.most is None or entry.size <= self.most):
                files.append((path, entry.size))
        return sorted(folders), files

    def partitions(self) -> list[InputPartition]:
        """Goes down from the root until there are subtrees enough."""
        system, base = file_system(self.root)
        folders, files = [""], []
        while folders and len(folders) < SUBTREES:
            deeper = []
            for folder in folders:
                inner, own = self._children(system, base, folder)
                deeper += inner
                files += own
            folders = deeper
        n = max(1, min(SUBTREES, len(folders) + len(files) // LISTED))
        return [Subtrees(folders[i::n], files[i::n]) for i in range(n)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.root)
        pending, files = list(partition.folders), list(partition.files)
        while pending or files:
            while pending and len(files) < LISTED:
                inner, own = self._children(system, base, pending.pop())
                pending += inner
                files += own
            if files:
                yield self._batch(files[:LISTED])
                files = files[LISTED:]

    def _batch(self, files: list[tuple[str, int]]) -> pa.RecordBatch:
        parts = [path.split("/") for path, _ in files]
        root = self.root.rstrip("/")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["/".join(p[: self.depth]) for p in parts]),
                pa.array(["/".join(p[self.depth :]) for p in parts]),
                pa.array([size for _, size in files], pa.int64()),
                pa.array([f"{root}/{path}" for path, _ in files]),
            ],
            ["repository_path", "file_path", "size_bytes", "uri"],
        )


class UnfilteredReader(ListingReader):
    """For sessions that push no filters into Python sources: they refuse a reader that takes some."""

    pushFilters = DataSourceReader.pushFilters  # noqa: N815 - Spark's name


class CorpusListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        options = dict(self.options)
        return (ListingReader if options.get("pushed") == "true" else UnfilteredReader)(options)


def list_files(
    spark: SparkSession, root: str, repository_depth: int = 0, ignored: list[str] | None = None, endings: list[str] | None = None, most: int | None = None
) -> DataFrame:
    """repository_path, file_path, size_bytes and uri of the files below ``root``; none is opened.

    Folders named in ``ignored``, below the repository, are not entered. ``endings`` are
    those of lower-cased names. Files of more than ``most`` bytes are left out. Filters reach the
    listing where the session pushes them (``spark.sql.python.filterPushdown.enabled``);
    elsewhere Spark applies them, with the same result.
    """
    spark.dataSource.register(CorpusListing)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    reader = spark.read.format("corpus_listing").option("repository_depth", repository_depth).option("pushed", pushed)
    reader = reader if most is None else reader.option("most", most)
    return reader.option("ignored_folders", json.dumps(ignored or [])).option("endings", json.dumps(endings or [""])).load(root)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("uri")
        begin, held, raw = 0, 0, []
        for i, uri in enumerate(batch.column(at).to_pylist()):
            system, path = file_system(uri)
            with system.open_input_stream(path) as stream:
                raw.append(stream.read())
            held += len(raw[-1])
            if held >= HELD or i + 1 == batch.num_rows:
                part = batch.slice(begin, i + 1 - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "raw"])
                begin, held, raw = i + 1, 0, []


def packed(listed: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The listed files (a written table) in partitions of about equal bytes.

    Files are dealt by hash into eight times as many lots as there will be tasks; a running sum
    over the lots, not over the files, cuts them into tasks. Files are small (their size is limited),
    so lots are even.
    """
    total = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    tasks = max(1, min(TASKS, -(-total // task_bytes)))
    lot = F.pmod(F.xxhash64("uri"), F.lit(8 * tasks))
    sizes = listed.groupBy(lot.alias("_lot")).agg(F.sum("size_bytes").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_lot")) - F.col("_size") / 2
    task = F.least(F.lit(tasks - 1), F.floor(before * tasks / max(total, 1))).cast("int")
    lots = sizes.select("_lot", F.coalesce(task, F.lit(0)).alias("_task"))  # 8 * TASKS rows at most
    dealt = listed.withColumn("_lot", lot).join(F.broadcast(lots), "_lot").drop("_lot")
    return dealt.repartitionById(tasks, F.col("_task")).drop("_task")


def opened(listed: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The listed files (a written table) with their bytes, ``raw``."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in listed.dtypes), "raw binary"])
    return packed(listed, task_bytes).mapInArrow(_open, schema)
