import random

from pyspark.sql import functions as F

from lintmill.operators import scoring
from lintmill.plans.static_review import DETECTORS, all_issues, run_static_review


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    # Scores are multiples of one half, so tenths are multiples of five.
    cases = [(5 * t, n) for n in range(1, 41) for t in range(0, 200 * n, n // 8 + 1)]
    cases += [(5 * rng.randrange(0, 200 * n + 1), n) for n in (rng.randrange(1, 5000) for _ in range(3000))]
    cases += [(t * 5, 200) for t in range(2000)]
    df = spark.createDataFrame(cases, "t long, n long")
    rows = df.select("t", "n", scoring.mean_2_decimals(F.col("t"), F.col("n")).alias("x")).collect()
    bad = [(r.t, r.n, r.x) for r in rows if r.x != round(r.t / 10 / r.n, 2)]
    assert not bad, bad[:5]


def test_file_scores(spark):
    counted = spark.createDataFrame(
        [("r", f, "go", 3) for f in "abcd"], "review_id string, file_path string, language string, line_count int"
    )
    issues = spark.createDataFrame(
        [("r", "a", "critical"), ("r", "a", "info"), ("r", "b", "odd"), ("r", "zz", "high")]
        + [("r", "c", "high")] * 11,
        "review_id string, file_path string, severity string",
    )
    rows = {r.file_path: (r.issues_count, r.file_score) for r in scoring.file_results(counted, issues).collect()}
    assert rows == {"a": (2, 84.5), "b": (1, 99.0), "c": (11, 0.0), "d": (0, 100.0)}


def test_reviews_without_files_score_100(spark):
    results = spark.createDataFrame([("r", 1, 97.12), ("r", 0, 97.13)], "review_id string, issues_count int, file_score double")
    reviews = spark.createDataFrame([("r",), ("empty",)], "id string")
    rows = {r.review_id: (r.files_analyzed, r.overall_score) for r in scoring.review_scores(results, reviews).collect()}
    assert rows["empty"] == (0, 100.0) and rows["r"][0] == 2


def test_static_review_end_to_end(spark, files):
    main = '"""Doc."""\n\ndef run(x):\n    return eval(x)\n'
    app = "console.log(1);\neval('2');\n"
    df = files(("r1", "main.py", main), ("r1", "app.js", app), ("r2", "ok.go", "package ok\n"))
    reviews = spark.createDataFrame([("r1", "p"), ("r2", "p"), ("r3", "p")], "id string, repository_id string")
    repositories = spark.createDataFrame([("p", "own", "name")], "id string, owner string, name string")
    done = run_static_review(df, reviews, repositories, F.current_timestamp())
    rows = {r.review_id: r for r in done.reviews.collect()}
    assert {r.status for r in rows.values()} == {"completed"}
    assert rows["r1"].files_analyzed == 2 and rows["r1"].issues_count == 4
    # main.py: 100 - 15 - 2; app.js: 100 - 15 - 0.5
    assert rows["r1"].overall_score == round((83 + 84.5) / 2, 2)
    assert rows["r1"].summary == "Analyzed 2 files in own/name. Found 4 issues with an overall score of 83.75."
    assert (rows["r2"].overall_score, rows["r3"].overall_score, rows["r3"].files_analyzed) == (100.0, 100.0, 0)
    per_file = done.file_results.groupBy("review_id").agg(F.sum("issues_count").alias("n")).collect()
    assert {r.review_id: r.n for r in per_file} == {"r1": 4, "r2": 0}
    assert all_issues(df).count() == done.issues.count() == 4
    without_python = {k: d for k, d in DETECTORS.items() if k != "python"}
    assert all_issues(df, without_python).count() == 2
