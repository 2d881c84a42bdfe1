import os

import pytest
from pyspark.sql import functions as F

from lintmill.sources import corpus, listing
from lintmill.sources.listing import ListingReader, can_list, list_files, opened, packed


def write(root, path, data=b"x = 1\n"):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)


def test_nothing_is_opened_that_is_left_out(spark, tmp_path):
    """A pipe without a writer would hang a scan that opens it, a dead link would end it."""
    for path in ("u/p/src/a.py", "u/p/b.js", "u/q/c.py"):
        write(tmp_path, path)
    for folder in ("u/p/node_modules/deep", "u/p/.git", "u/q/x.py"):
        (tmp_path / folder).mkdir(parents=True)
    os.mkfifo(tmp_path / "u/p/node_modules/deep/a.js")
    os.mkfifo(tmp_path / "u/p/.git/a.py")
    os.mkfifo(tmp_path / "u/p/src/pipe.py")
    os.symlink("/nowhere/at/all.py", tmp_path / "u/p/node_modules/dead.py")
    os.symlink(tmp_path / "u", tmp_path / "u/p/src/loop")
    files = corpus.read_corpus(spark, str(tmp_path), repository_depth=2)
    assert sorted((r.review_id, r.file_path, r.content) for r in files.collect()) == [
        ("u/p", "b.js", "x = 1\n"), ("u/p", "src/a.py", "x = 1\n"), ("u/q", "c.py", "x = 1\n")]


def test_equals_sparks_own_scan(spark, tmp_path):
    for i in range(60):
        write(tmp_path, f"u{i % 3}/r{i % 2}/" + ["a/", "", "dist/", "a/b/c/d/"][i % 4] + f"f{i}" + [".py", ".GO", ".md", "", ".min.js"][i % 5], b"x" * i)
    listed = list_files(spark, f"file://{tmp_path}", 2)
    plain = corpus.list_corpus(spark, str(tmp_path), 2)
    columns = ["repository_path", "file_path", "size_bytes"]
    rows = sorted(map(tuple, listed.select(columns).collect()))
    # Spark's own scan passes over empty files, which have findings as well.
    assert [r for r in rows if r[2]] == sorted(map(tuple, plain.select(columns).collect())) and len(rows) == 60


def test_filters_reach_the_listing(spark, tmp_path):
    for user in "abc":
        for n in (1, 10, 100):
            write(tmp_path, f"{user}/r/f{n}.py", b"x" * n)
    rows = list_files(spark, str(tmp_path), 2).where("size_bytes <= 10 and repository_path = 'b/r'")
    assert sorted(r.size_bytes for r in rows.collect()) == [1, 10]
    reader = ListingReader({"path": str(tmp_path), "repository_depth": "2"})
    left = list(reader.pushFilters([listing.LessThan(("size_bytes",), 100), listing.In(("repository_path",), ("b/r", "c/r")), listing.EqualTo(("file_path",), "x")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    found = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted((r["repository_path"], r["size_bytes"]) for r in found) == [("b/r", 1), ("b/r", 10), ("c/r", 1), ("c/r", 10)]


def test_many_subtrees(monkeypatch, tmp_path):
    """Every file is listed once, however the tree is cut up."""
    paths = [f"{i % 7}/{i % 5}/{'/'.join('ab'[: i % 3])}f{i}.py" for i in range(200)]
    for path in paths:
        write(tmp_path, path)
    for subtrees, listed in ((1, 3), (4, 1000), (30, 1), (1000, 50)):
        monkeypatch.setattr(listing, "SUBTREES", subtrees)
        monkeypatch.setattr(listing, "LISTED", listed)
        reader = ListingReader({"path": str(tmp_path)})
        parts = reader.partitions()
        found = [row["file_path"] for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
        assert sorted(found) == sorted(paths) and len(parts) <= max(subtrees, 1)


def test_partitions_of_equal_bytes(spark):
    sizes = [1000 + i * 37 % 9000 for i in range(4000)]
    listed = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sizes)], "uri string, size_bytes long")
    dealt = packed(listed, sum(sizes) // 20)
    by = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size_bytes").alias("n")).collect()
    assert len(by) >= 20 and max(r.n for r in by) < 1.3 * sum(sizes) / 20
    assert packed(listed.where("uri = 'none'")).count() == 0


def test_opened_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "HELD", 10)
    for i in range(9):
        write(tmp_path, f"f{i}.py", bytes([i]) * i * 3)
    rows = opened(list_files(spark, str(tmp_path))).collect()
    assert sorted((r.file_path, bytes(r.raw)) for r in rows) == [(f"f{i}.py", bytes([i]) * i * 3) for i in range(9)]


def test_owners_limits_after_the_listing(spark, tmp_path):
    for owner in ("a", "b", "c"):
        for path in ("dist/x.py", "vendor2/y.py", "z.js"):
            write(tmp_path, f"{owner}/r/{path}")
    owners = spark.createDataFrame([("a/r", "ua"), ("b/r", "ub")], "repository_path string, user_id string")
    settings = spark.createDataFrame(
        [("ua", "vendor2", ".js", 100), ("ub", "dist", "", 3)], "user_id string, ignored_folders string, ignored_extensions string, max_file_size_bytes int")
    files = corpus.read_corpus(spark, str(tmp_path), repository_depth=2, owners=owners, settings=settings)
    assert sorted((r.review_id, r.file_path) for r in files.collect()) == [("a/r", "dist/x.py"), ("c/r", "vendor2/y.py"), ("c/r", "z.js")]
    assert "dist" not in corpus.common_folders(settings) and corpus.common_folders() == corpus.common_folders(settings.where("false"))


@pytest.mark.parametrize(("uri", "listable"), [("/tmp", True), ("file:///tmp", True), ("file:/tmp", True), ("viewfs://store/in", False)])
def test_stores(uri, listable):
    assert can_list(uri) == listable


def test_a_session_that_pushes_no_filters(spark, tmp_path):
    from lintmill.session import setting

    for name, size in (("a", 3), ("b", 30), ("c", 300)):
        write(tmp_path, f"r/{name}.py", b"x" * size)
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "false"):
        rows = list_files(spark, str(tmp_path), 1, most=100).where("size_bytes <= 10 and repository_path = 'r'").collect()
        assert [(r.file_path, r.size_bytes) for r in rows] == [("a.py", 3)]
        assert sorted(r.file_path for r in list_files(spark, str(tmp_path), 1, most=100).collect()) == ["a.py", "b.py"]
        assert corpus.read_corpus(spark, str(tmp_path), repository_depth=1).count() == 3
