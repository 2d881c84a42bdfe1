"""User settings: merging with defaults, patching, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions.text import csv_list, strip, unicode_pattern
from lintmill.schemas import DEFAULT_SETTINGS, MAX_FILE_SIZE_SETTING, MIN_FILE_SIZE_SETTING

TEXT_FIELDS = ["ollama_base_url", "ollama_model", "ignored_folders", "ignored_extensions"]
SIZE_FIELD = "max_file_size_bytes"
FIELDS = [*TEXT_FIELDS, SIZE_FIELD]


def effective_settings(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Each user's settings: the own value unless empty or zero, else the default.

    ``users`` has user_id.  The defaults are literals, so nothing is joined for them.
    """
    joined = users.select("user_id").join(settings.select("user_id", *FIELDS), "user_id", "left")
    own = {f: F.nullif(F.col(f), F.lit("")) for f in TEXT_FIELDS}
    own[SIZE_FIELD] = F.nullif(F.col(SIZE_FIELD), F.lit(0))
    columns = [
        F.coalesce(own[f], F.lit(default)).alias(f) if f in own else F.lit(default).alias(f)
        for f, default in DEFAULT_SETTINGS.items()
    ]
    return joined.select("user_id", *columns)


def settings_lists(effective: DataFrame) -> DataFrame:
    """Add the ignore lists as arrays."""
    return effective.withColumn(
        "ignored_folder_list", csv_list(F.col("ignored_folders"))
    ).withColumn("ignored_extension_list", csv_list(F.col("ignored_extensions")))


def check_patches(patches: DataFrame) -> DataFrame:
    """Add ``error`` to patches (user_id, seq, changes); null means accepted.

    A patch is accepted or refused whole.  A size that is no number is refused.
    """
    value = {f: F.try_element_at("changes", F.lit(f)) for f in FIELDS}
    size = F.nullif(value[SIZE_FIELD], F.lit(""))
    read = patches.select(
        "*", F.struct(*[value[f].alias(f) for f in TEXT_FIELDS], size.try_cast("int").alias(SIZE_FIELD)).alias("_p")
    )
    number = F.when(size.isNotNull() & size.try_cast("int").isNull(), "size_not_a_number")
    return read.withColumn("error", F.coalesce(number, _error(lambda f: F.col("_p")[f]))).drop("_p")


def patch_settings(settings: DataFrame, patches: DataFrame, at: Column | None = None) -> DataFrame:
    """Apply patches (user_id, seq, changes map<string,string>) in order of seq.

    A field not named is kept, null or empty clears it, anything else sets it.
    Per field the last patch that names it decides, so a user's patches fold in
    one aggregation; a user without a row gets one.  Patches that
    ``check_patches`` refuses change nothing.  With ``at`` the rows are complete
    rows of the settings table: those of patched users are stamped with it.
    """
    patches = check_patches(patches).where(F.col("error").isNull())

    def last(field: str):
        changes = F.col("changes")
        return F.max(
            F.when(
                F.map_contains_key(changes, field),
                F.struct(F.col("seq").alias("seq"), F.try_element_at(changes, F.lit(field)).alias("value")),
            )
        ).alias(f"_{field}")

    folded = patches.groupBy("user_id").agg(*[last(f) for f in FIELDS])
    stamps = ["created_at", "updated_at"] if at is not None else []
    folded = folded.withColumn("_patched", F.lit(True))
    joined = settings.select("user_id", *FIELDS, *stamps).join(folded, "user_id", "full_outer")
    columns = []
    for f in FIELDS:
        value = F.nullif(F.col(f"_{f}.value"), F.lit(""))
        value = value.try_cast("int") if f == SIZE_FIELD else value
        columns.append(F.when(F.col(f"_{f}").isNotNull(), value).otherwise(F.col(f)).alias(f))
    if at is not None:
        columns.append(F.coalesce("created_at", at).alias("created_at"))
        columns.append(F.when(F.col("_patched"), at).otherwise(F.col("updated_at")).alias("updated_at"))
    return joined.select("user_id", *columns)


def _error(field: Callable[[str], Column]) -> Column:
    url, model, size = field("ollama_base_url"), field("ollama_model"), field(SIZE_FIELD)
    bad_scheme = (url != "") & ~strip(url).rlike(unicode_pattern("^(?i)https?://"))
    return (
        F.when(F.length(url) > 512, "url_too_long")
        .when(F.length(model) > 128, "model_too_long")
        .when((size < MIN_FILE_SIZE_SETTING) | (size > MAX_FILE_SIZE_SETTING), "size_out_of_range")
        .when(bad_scheme, "url_scheme")
    )


def validate_settings(updates: DataFrame) -> DataFrame:
    """Add ``error`` to settings updates; null means accepted."""
    return updates.withColumn("error", _error(F.col))
