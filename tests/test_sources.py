from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintmill.plans.static_review import all_issues
from lintmill.schemas import FILES, TABLES
from lintmill.sources import corpus, sinks, tables
from lintmill.streaming.incremental import stream_files, stream_issues


def write(root, path, data):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)


def test_corpus_from_directories(spark, tmp_path):
    root = tmp_path / "work"
    for path, data in {
        "u/p1/a/b.py": b"x = 1\r\n", "u/p1/a.py": b"\xff", "u/p1/node_modules/c.js": b"eval(1)", "u/p1/.py": b"",
        "u/p1/d.min.js": b"var a", "u/p1/e.md": b"", "u/p2/big.go": b"a" * 1_048_577, "u/p2/ok.GO": b"a" * 1_048_576,
        "u/p2/l.lock": b"", "u/p2/dist": b"x",
    }.items():
        write(root, path, data)
    files = corpus.read_corpus(spark, str(root), repository_depth=2)
    ordered = [(r.review_id, r.file_path, r.language) for r in corpus.in_path_order(files).collect()]
    assert ordered == [("u/p1", "a/b.py", "python"), ("u/p1", "a.py", "python"), ("u/p1", "d.min.js", "javascript"),
                       ("u/p2", "ok.GO", "go")]
    texts = {r.file_path: r.content for r in files.collect()}
    assert texts["a/b.py"] == "x = 1\n" and texts["a.py"] == "�"
    one = corpus.read_corpus(spark, f"file:{root}", review_id="r")
    assert {r.review_id for r in one.collect()} == {"r"} and one.where("file_path = 'u/p2/ok.GO'").count() == 1


def test_limits_of_each_user(spark):
    listed = spark.createDataFrame(
        [(u, p, 100) for u in ("a", "b") for p in ("src/x.py", "src/x.js", "lib/y.py")], "user_id string, file_path string, size_bytes long")
    limits = spark.createDataFrame([("a", "lib", ".JS", 100), ("b", "", "", 99)],
        "user_id string, ignored_folders string, ignored_extensions string, max_file_size_bytes int")
    rows = corpus.analyzable(listed, limits).collect()
    assert [(r.user_id, r.file_path) for r in rows] == [("a", "src/x.py")]


def issue(review, path, rule):
    return (review, path, 1, None, "bug", "low", 0.5, rule, "t", "e", "s", None)


def test_replacing_results_on_disk(spark, tmp_path):
    folder, schema = str(tmp_path), TABLES["review_issues"]
    old = [issue(r, p, "old") for r in ("r1", "r2", "r3") for p in ("a", "b")]
    stored = spark.createDataFrame(old, schema)
    sinks.write_children(stored, folder, "review_issues", stored)
    new = spark.createDataFrame([issue("r1", "a", "new")], schema)
    finished = spark.createDataFrame([("r1",), ("r3",)], "review_id string")
    for _ in range(2):  # a repeated run changes nothing
        sinks.replace_results(spark, folder, "review_issues", new, finished)
        spark.catalog.clearCache()
        rows = tables.read_table(spark, folder, "review_issues").collect()
        assert sorted((r.review_id, r.file_path, r.rule_id) for r in rows) == [
            ("r1", "a", "new"), ("r2", "a", "old"), ("r2", "b", "old")]
    one = tables.read_table(spark, folder, "review_issues", "r2")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(review_bucket" in one._jdf.queryExecution().toString()


def test_a_job_that_stops_in_between_leaves_the_old_state(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path), TABLES["review_issues"]
    stored = spark.createDataFrame([issue("r1", "a", "old"), issue("r2", "b", "old")], schema)
    sinks.write_children(stored, folder, "review_issues", stored)

    class Stop:
        def select(self, *_):
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        sinks.replace_results(spark, folder, "review_issues", spark.createDataFrame([issue("r1", "a", "new")], schema), Stop())
    rows = tables.read_table(spark, folder, "review_issues").collect()
    assert sorted((r.review_id, r.rule_id) for r in rows) == [("r1", "old"), ("r2", "old")]


def test_finishing_reviews(spark):
    at = datetime(2024, 1, 1)
    requests = spark.createDataFrame([("p", "u", "ai", "running"), ("p", "u", "static", None)],
        "repository_id string, user_id string, review_type string, status string")
    reviews = sinks.create_reviews(requests, F.lit(at))
    again = sinks.create_reviews(requests, F.lit(at))
    assert reviews.join(again, "id").count() == 2
    assert reviews.columns == TABLES["reviews"].fieldNames()
    results = reviews.where("review_type = 'ai'").select(
        F.col("id").alias("review_id"), F.lit("completed").alias("status"), F.lit(2).alias("files_analyzed"), F.lit(3).alias("issues_count"),
        F.lit(9.5).alias("overall_score"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("error_message"),
        F.lit(at).alias("completed_at"), F.lit(None).cast("string").alias("ai_model"), F.lit("# md").alias("report_markdown"))
    rows = {r.review_type: r for r in sinks.finish_reviews(reviews, results).collect()}
    assert (rows["ai"].status, rows["ai"].ai_model, rows["ai"].report_markdown) == ("completed", "qwen2.5", "# md")
    assert (rows["static"].status, rows["static"].files_analyzed) == ("pending", 0)


def test_backfill(spark):
    old = spark.createDataFrame([("a", "p", "u", "completed")], "id string, repository_id string, user_id string, status string")
    [row] = tables.backfill("reviews", old).collect()
    assert (row.review_type, row.ai_model, row.overall_score) == ("static", None, 0.0)
    [user] = tables.backfill("users", spark.createDataFrame([("a", "e")], "id string, email string")).collect()
    assert user.auth_provider == "local" and user.github_id is None


def test_reports_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("r", "json", "f", "m", 0, 0, "", "{}")],
        "review_id string, format string, filename string, media_type string, section int, rank int, path_key string, text string")
    sinks.write_reports(rows, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports")).where("format = 'json'").count() == 1


def test_answers_from_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"review_id": "r", "raw": "{\\"summary\\": \\"s\\"}"}\n')
    [row] = tables.read_answers(spark, str(tmp_path)).collect()
    assert tuple(row) == ("r", '{"summary": "s"}')


def test_line_rules_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame([("r", "a.js", "javascript", 7, "eval(1)\n"), ("r", "b.go", "go", 600, "\n" * 600)], FILES).write.parquet(path)
    query = stream_issues(stream_files(spark, path)).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.rule_id for r in spark.table("found").collect()) == ["js-eval", "large-file"]


def test_partitions_do_not_matter(spark, files):
    df = files(*[(f"d{i % 3}/f{i}.py", "import os\n" + "x = 1\n" * (i % 9) + "def f(): eval(1)\n") for i in range(40)])
    one = sorted(map(tuple, all_issues(df.repartition(1)).collect()))
    many = sorted(map(tuple, all_issues(df.repartition(7, "file_path")).collect()))
    assert one == many and len(one) > 100
