"""The package in a process of its own, from another folder, without any setting."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

STATIC = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from lintmill.session import share_package
from lintmill.plans.static_review import run_static_review
share_package(spark)
files = spark.createDataFrame([("r", "a.py", "python", "import os\\neval('1')\\n"), ("r", "b.js", "javascript", "var a\\n" * 9)],
    "review_id string, file_path string, language string, content string")
reviews = spark.createDataFrame([("r", "p")], "id string, repository_id string")
repositories = spark.createDataFrame([("p", "own", "name")], "id string, owner string, name string")
done = run_static_review(files, reviews, repositories, F.current_timestamp())
print("FOUND", done.issues.count(), done.reviews.first().status)
"""

QUERY = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
names = {names!r}
queries = __spark_entry__.queries()
print("FOUND", *[queries[n](spark, "/root/testdata/sf0.001").count() > 0 for n in names if n in queries])
"""


def run(program, folder):
    # An empty folder of settings: nothing names a shared folder.
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(folder)}
    done = subprocess.run([sys.executable, "-c", program], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND" in done.stdout, done.stderr[-2000:]
    return done.stdout.split("FOUND", 1)[1].split()


def test_static_review(tmp_path):
    n, status = run(STATIC.format(root=ROOT), tmp_path)
    assert int(n) >= 5 and status == "completed"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_registered_queries(tmp_path):
    assert set(run(QUERY.format(root=ROOT, names=["py_all_rules", "op13_spelling_variants"]), tmp_path)) == {"True"}
