"""Line and file rules over arriving files.

These rules look at one file only and keep no state, so they run on a stream as
they are.  Duplicate blocks and scores need whole reviews and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintmill.operators.line_rules import large_file_issues, line_issues
from lintmill.schemas import FILES


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``files`` rows written as Parquet."""
    return spark.readStream.schema(FILES).parquet(path)


def stream_issues(files: DataFrame) -> DataFrame:
    """Issues of arriving files."""
    return line_issues(files).unionByName(large_file_issues(files))
