import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package as well.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from lintmill.session import local_session

    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Make a files table of (path, content) or (review, path, content)."""
    from lintmill.functions.text import language_of

    def make(*rows):
        full = [("r", *row) if len(row) == 2 else row for row in rows]
        df = spark.createDataFrame(full, "review_id string, file_path string, content string")
        return df.withColumn("language", language_of(df["file_path"]))

    return make
