"""From folders to stored reviews and back, in one job."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lintmill.operators import search
from lintmill.operators.catalogue import review_detail
from lintmill.operators.maintenance import audit_orphans, audit_unique
from lintmill.operators.text_index import TextIndex
from lintmill.plans.corpus_review import review_corpus
from lintmill.schemas import TABLES
from lintmill.sources.runs import delete_reviews
from lintmill.sources.tables import read_catalogue, read_table

AT = datetime(2024, 5, 1, 12)


def repository(i, user, path, status="ready"):
    return (i, user, f"https://github.com/own/{i}", "own", i, "main", path, status, None, AT, AT, AT)


@pytest.fixture
def stored(spark, tmp_path):
    root, folder = tmp_path / "w", str(tmp_path / "catalogue")
    texts = {
        "u1/p1/app.py": '"""App."""\nimport os\n\n\ndef start():\n    """Start."""\n    eval("1")\n', "u1/p1/web/a.js": "var needle = 1;\n" + "x();\n" * 9,
        "u1/p1/node_modules/b.js": "eval(1)\n", "u1/p2/empty.py": "", "u2/p3/m.go": 'panic("x")\n', "u2/other/z.go": 'panic("x")\n', "u2/big/a.py": "x = 1\n" * 600}
    for path, text in texts.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    rows = [repository(p, u, f"{root}/{u}/{p}") for p, u in (("p1", "u1"), ("p2", "u1"), ("p3", "u2"), ("big", "u2"))]
    rows += [repository("p4", "u2", f"{root}/u2/gone", "cloning"), repository("nowhere", "u2", "/elsewhere/p")]
    spark.createDataFrame(rows, TABLES["repositories"]).write.parquet(f"{folder}/repositories")
    spark.createDataFrame([(u, f"{u}@x.io", None, None, None, None, None, "local", True, AT, AT) for u in ("u1", "u2")], TABLES["users"]).write.parquet(f"{folder}/users")
    spark.createDataFrame([], TABLES["user_settings"]).write.parquet(f"{folder}/user_settings")
    return str(root), folder


def test_from_folders_to_search_and_back(spark, stored):
    root, folder = stored
    requests = spark.createDataFrame(
        [("p1", "u1"), ("p1", "u1"), ("p2", "u1"), ("p3", "u2"), ("p3", "u1"), ("p4", "u2"), ("nowhere", "u2"), ("big", "u2")], "repository_id string, user_id string")
    outcome = {(r.repository_id, r.user_id): (r.outcome, r.review_id) for r in review_corpus(spark, root, folder, requests, F.lit(AT), 2).collect()}
    assert {k: v[0] for k, v in outcome.items()} == {("p1", "u1"): "ready", ("p2", "u1"): "ready", ("p3", "u2"): "ready", ("big", "u2"): "ready",
                                                     ("p3", "u1"): "not_found", ("p4", "u2"): "not_ready", ("nowhere", "u2"): "ready"}
    of = {k[0]: v[1] for k, v in outcome.items() if v[0] == "ready"}
    reviews = {r.id: r for r in read_table(spark, folder, "reviews").collect()}
    assert set(reviews) == set(of.values()) and {r.status for r in reviews.values()} == {"completed"}
    rules = {p: sorted(r.rule_id for r in read_table(spark, folder, "review_issues", of[p]).collect()) for p in of}
    assert rules["p1"] == ["duplicated-block", "js-var-keyword", "python-eval-exec", "unused-import"]
    assert rules["p2"] == ["missing-module-docstring"] and rules["p3"] == ["go-panic"] and rules["nowhere"] == []
    assert "large-file" in rules["big"]
    files = {p: sorted((r.file_path, r.issues_count) for r in read_table(spark, folder, "file_analysis_results", of[p]).collect()) for p in ("p1", "p2")}
    assert files == {"p1": [("app.py", 2), ("web/a.js", 2)], "p2": [("empty.py", 1)]}
    p1 = reviews[of["p1"]]
    assert (p1.files_analyzed, p1.issues_count) == (2, 4) and "eval" in p1.report_markdown and p1.summary.startswith("Analyzed 2 files in own/p1.")

    tables = read_catalogue(spark, folder)
    assert audit_unique(tables).count() == 0 and audit_orphans(tables).count() == 0
    params = search.SearchParams(q="web/a")
    found = [search.search(tables["reviews"], tables["repositories"], tables["review_issues"], params, index) for index in (None, TextIndex(spark, f"{folder}/text_index"))]
    assert [[r.id for r in f.collect()] for f in found] == [[of["p1"]]] * 2
    detail = review_detail(tables["reviews"], tables["review_issues"], tables["file_analysis_results"], of["p1"], "u1")
    assert detail.issues.count() == 4

    delete_reviews(spark.createDataFrame([(of["p1"],)], "id string"), folder)
    tables = read_catalogue(spark, folder)
    assert of["p1"] not in {r.id for r in tables["reviews"].collect()} and audit_orphans(tables).count() == 0


def test_a_job_that_is_run_again(spark, stored, monkeypatch):
    """Stopped before the review rows, it leaves no review; run again, one of each."""
    root, folder = stored
    requests = spark.createDataFrame([("p1", "u1")], "repository_id string, user_id string")
    append = TextIndex.append
    with monkeypatch.context() as patch:
        patch.setattr(TextIndex, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            review_corpus(spark, root, folder, requests, F.lit(AT), 2)
    assert TextIndex.append is append
    [row] = review_corpus(spark, root, folder, requests, F.lit(AT), 2).collect()
    assert read_table(spark, folder, "reviews").count() == 1
    assert read_table(spark, folder, "review_issues", row.review_id).count() == 4
