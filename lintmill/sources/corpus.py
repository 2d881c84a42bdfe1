"""Source files: directories of repositories to rows of ``files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.functions.text import csv_list, decode, language_of, path_key, suffix
from lintmill.schemas import DEFAULT_SETTINGS, LANGUAGE_BY_EXTENSION, MAX_FILE_SIZE_SETTING
from lintmill.session import written
from lintmill.sources.listing import can_list, list_files, opened


def outside_folders(path: Column, folders: Column) -> Column:
    """No part of the path, the file name included, is one of the folders."""
    return ~F.arrays_overlap(F.split(path, "/", -1), folders)


def without_extensions(path: Column, extensions: Column) -> Column:
    """The last extension is none of these; only the last one is looked at, so an
    entry such as ``.min.js`` matches nothing."""
    return ~F.array_contains(F.transform(extensions, F.lower), suffix(path))


def analyzable(files: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Files (file_path, size_bytes, ...) that are to be analysed, with ``language``.

    With ``settings`` (see ``effective_settings``) each file is held against the
    limits of its ``user_id``; otherwise, and for users not in it, against the
    defaults.
    """
    columns = [c for c in files.columns if c != "language"]
    if settings is None:
        limited = files.select(
            *columns,
            F.lit(DEFAULT_SETTINGS["ignored_folders"]).alias("_folders"),
            F.lit(DEFAULT_SETTINGS["ignored_extensions"]).alias("_extensions"),
            F.lit(DEFAULT_SETTINGS["max_file_size_bytes"]).alias("_max"),
        )
    else:
        limits = settings.select(
            "user_id",
            F.col("ignored_folders").alias("_folders"),
            F.col("ignored_extensions").alias("_extensions"),
            F.col("max_file_size_bytes").alias("_max"),
        )
        joined = files.select(*columns).join(limits, "user_id", "left")
        defaults = {"_folders": "ignored_folders", "_extensions": "ignored_extensions", "_max": "max_file_size_bytes"}
        limited = joined.withColumns({c: F.coalesce(c, F.lit(DEFAULT_SETTINGS[f])) for c, f in defaults.items()})
    path = F.col("file_path")
    language = language_of(path)
    keep = (
        language.isNotNull()
        & (F.col("size_bytes") <= F.col("_max"))
        & outside_folders(path, csv_list(F.col("_folders")))
        & without_extensions(path, csv_list(F.col("_extensions")))
    )
    return limited.where(keep).select(*columns, language.alias("language"))


def source_glob() -> str:
    """A file-name pattern of the known extensions, in either case."""
    either = ["".join(f"[{c}{c.upper()}]" for c in extension.lstrip(".")) for extension in LANGUAGE_BY_EXTENSION]
    return "*.{" + ",".join(either) + "}"


def list_corpus(
    spark: SparkSession, root: str, repository_depth: int = 0, names: str | None = None
) -> DataFrame:
    """Every file below ``root``: repository_path, file_path, size_bytes, raw.

    The first ``repository_depth`` path parts name the repository.  Files whose name
    does not fit the pattern ``names``, or that are larger than any user may ask for,
    are not opened: both filters reach the scan.  Nor is any if ``raw`` is not used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    found = reader.load(root).where(F.col("length") <= MAX_FILE_SIZE_SETTING)
    plain_root = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    start = F.instr("path", plain_root) + len(plain_root) + 1
    parts = F.split(F.substr("path", start), "/", -1)
    head = F.slice(parts, 1, repository_depth) if repository_depth else F.array().cast("array<string>")
    rest = F.slice(parts, F.lit(repository_depth + 1), F.size(parts))
    return found.select(
        F.array_join(head, "/").alias("repository_path"),
        F.array_join(rest, "/").alias("file_path"),
        F.col("length").alias("size_bytes"),
        F.col("content").alias("raw"),
    )


def decoded(listed: DataFrame) -> DataFrame:
    """Bytes to text and path separators to slashes, after all filters."""
    return listed.withColumn("content", decode(F.col("raw"))).withColumn(
        "file_path", F.replace("file_path", F.lit("\\"), F.lit("/"))
    ).drop("raw")


def common_folders(settings: DataFrame | None = None) -> list[str]:
    """The folders that everybody ignores: those of the defaults that all ``settings`` name as well."""
    defaults = [f.strip() for f in DEFAULT_SETTINGS["ignored_folders"].split(",") if f.strip()]
    if settings is None:
        return defaults
    folders = csv_list(F.coalesce("ignored_folders", F.lit(DEFAULT_SETTINGS["ignored_folders"])))
    kept = [F.coalesce(F.min(F.array_contains(folders, f).cast("int")), F.lit(1)).alias(f"f{i}") for i, f in enumerate(defaults)]
    return [f for f, every in zip(defaults, settings.agg(*kept).first(), strict=True) if every]


def read_corpus(
    spark: SparkSession,
    root: str,
    review_id: str | None = None,
    repository_depth: int = 0,
    owners: DataFrame | None = None,
    settings: DataFrame | None = None,
    only_owned: bool = False,
) -> DataFrame:
    """The analysable files below ``root`` as a ``files`` table.

    ``review_id`` names the review; without it each repository is its own.  With
    ``owners`` (repository_path, user_id) and ``settings`` (see ``effective_settings``)
    a file is held against its owner's limits, otherwise against the defaults; with
    ``only_owned`` files of other repositories are not opened.

    Paths are listed and chosen first and only the chosen files are opened (see
    ``listing``). In a store that only Spark can read, Spark's own scan lists and opens.
    """
    two_phase = can_list(root)
    if two_phase:
        endings = [e.lower() for e in LANGUAGE_BY_EXTENSION]
        folders = common_folders(settings if owners is not None else None)
        listed = list_files(spark, root, repository_depth, folders, endings, MAX_FILE_SIZE_SETTING)
    else:
        listed = list_corpus(spark, root, repository_depth, source_glob())
    if owners is not None:
        listed = listed.join(owners.select("repository_path", "user_id"), "repository_path", "inner" if only_owned else "left")
    kept = analyzable(listed, settings if owners is not None else None)
    if two_phase:
        kept = opened(written(kept, "listing"))
    kept = decoded(kept)
    review = F.lit(review_id) if review_id is not None else F.col("repository_path")
    return kept.select(
        review.alias("review_id"), "file_path", "language", "size_bytes", "content"
    )


def in_path_order(files: DataFrame) -> DataFrame:
    """Sorted as a walk over sorted directories visits the files (a distributed sort)."""
    return files.orderBy("review_id", path_key(F.col("file_path")))
