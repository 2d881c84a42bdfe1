"""Session settings the jobs are tuned for.

Nothing below is required for right results except the time zone, which the
report dates are rendered in.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key inside one JSON answer keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Source texts are wide rows: few of them fill an Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The corpus listing takes filters.
    "spark.sql.python.filterPushdown.enabled": "true",
    # Walking the Python stack for every column expression slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: The folder that the package lies in.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Let the Python workers of a session find the package where the driver found it.

    That is enough where they see the same folder. On a cluster that does not, install the
    package on the nodes, or hand a zip of it to ``spark.submit.pyFiles``.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def local_session(name: str = "lintmill", cores: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LINTMILL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark


#: Temporary folders of local sessions, by application.
_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; only a local session, where
    that is unset, gets a temporary folder. (The setting itself cannot be changed once a
    session runs.)
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="lintmill-")
    return _FOLDERS[context.applicationId]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A SQL setting for the jobs run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    What follows depends on the written files, so a lost executor costs no second
    scan of the corpus, and the plans that follow stay small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lintmill/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
