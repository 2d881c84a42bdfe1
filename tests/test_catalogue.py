from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lintmill.operators import catalogue, joins
from lintmill.operators.search import SearchParams, search, search_page, search_positions, search_total

T0 = datetime(2024, 1, 1)
REVIEW = """id string, repository_id string, user_id string, status string, review_type string, ai_model string,
    report_markdown string, files_analyzed int, issues_count int, overall_score double, summary string,
    created_at timestamp"""


@pytest.fixture(scope="module")
def tables(spark):
    reviews = spark.createDataFrame(
        [
            ("a", "p", "u", "completed", "static", None, None, 1, 3, 80.0, "All 100% fine", T0),
            ("b", "p", "u", "failed", "ai", "m", "# Secret report", 0, 0, 20.0, None, T0 + timedelta(days=1)),
            ("c", "q", "u", "completed", "static", None, None, 2, 9, 60.0, "", T0 + timedelta(days=1)),
            ("d", "s", "v", "completed", "static", None, None, 2, 1, 50.0, "x", T0 + timedelta(days=2)),
        ],
        REVIEW,
    )
    repositories = spark.createDataFrame(
        [("p", "u", "Own", "name", "ready", "/w", T0), ("q", "u", "own", "Äpfel_x", "ready", "", T0),
         ("s", "v", "own", "z", "failed", None, T0), ("t", "u", "own", "t", "pending", None, T0 + timedelta(hours=1))],
        "id string, user_id string, owner string, name string, status string, local_path string, created_at timestamp",
    )
    issues = spark.createDataFrame(
        [("a", "src/a.py", "high", "Hardcoded secret", "e"), ("a", "src/b.py", "low", "t", "e"),
         ("c", "src/c.py", "low", "t", None)],
        "review_id string, file_path string, severity string, title string, explanation string",
    )
    return reviews, repositories, issues


def ids(tables, **params):
    return sorted(r.id for r in search(*tables, SearchParams(**params)).collect())


def test_each_filter(tables):
    assert ids(tables) == ["a", "b", "c", "d"]
    assert ids(tables, user_id="u") == ["a", "b", "c"]
    assert ids(tables, user_id="u", repository_id="q") == ["c"]
    assert ids(tables, user_id="v", repository_id="q") == []
    assert ids(tables, review_type="ai") == ["b"]
    assert ids(tables, status="completed", min_score=50.0, max_score=60.0) == ["c", "d"]
    assert ids(tables, from_date=T0 + timedelta(days=1), to_date=T0 + timedelta(days=1)) == ["b", "c"]
    assert ids(tables, severity="low") == ["a", "c"]
    assert ids(tables, severity="HIGH") == []


def test_text(tables):
    assert ids(tables, q="secret") == ["a", "b"]
    assert ids(tables, q=" SRC/C ") == ["c"]
    assert ids(tables, q="äPFEL") == ["c"]
    assert ids(tables, q="0%f") == ["a"]
    assert ids(tables, q="own", severity="high") == ["a"]
    assert ids(tables, q=r"100\%") == ["a"]
    assert ids(tables, q=r"l\_x") == ["c"]
    assert ids(tables, q=r"\f\i") == ["a"]
    assert ids(tables, q="") == ids(tables, q="   ") == ["a", "b", "c", "d"]


def test_pages_orders_totals(tables):
    found = search(*tables, SearchParams(user_id="u"))
    page = search_page(found, SearchParams(user_id="u", sort="-overall_score", offset=1, limit=1))
    assert [r.id for r in page.collect()] == ["c"]
    orders = {"-created_at": "bca", "created_at": "abc", "overall_score": "bca", "-issues_count": "cab", "issues_count": "bac"}
    for sort, wanted in orders.items():
        page = search_page(found, SearchParams(user_id="u", sort=sort))
        assert "".join(r.id for r in page.collect()) == wanted
        placed = {r.position: r.id for r in search_positions(found, sort).collect()}
        assert "".join(placed[i] for i in sorted(placed)) == wanted
    assert [(r.user_id, r.total) for r in search_total(found).collect()] == [("u", 3)]
    everyone = search_page(search(*tables, SearchParams()), SearchParams(limit=1)).collect()
    assert sorted((r.user_id, r.position, r.id) for r in everyone) == [("u", 1, "b"), ("v", 1, "d")]


@pytest.mark.parametrize(
    "bad", [{"limit": 0}, {"limit": 101}, {"offset": -1}, {"min_score": -1.0}, {"sort": "id"}, {"q": "x" * 201},
            {"status": "done"}, {"review_type": "x"}]
)
def test_bounds(bad):
    with pytest.raises(ValueError):
        SearchParams(**bad)


def test_lookups(spark, tables):
    reviews, repositories, issues = tables
    detail = catalogue.review_detail(reviews, issues, issues.select("review_id", "file_path"), "a", "u")
    assert (detail.review.count(), detail.issues.count(), detail.file_results.count()) == (1, 2, 2)
    assert catalogue.review_detail(reviews, issues, issues, "a", "v").issues.count() == 0
    requests = spark.createDataFrame(
        [("p", "u"), ("q", "u"), ("p", "v"), ("t", "u"), ("none", "u")], "repository_id string, user_id string"
    )
    gate = {(r.repository_id, r.user_id): r.outcome for r in catalogue.ready_gate(requests, repositories).collect()}
    assert gate == {("p", "u"): "ready", ("q", "u"): "not_ready", ("p", "v"): "not_found",
                    ("t", "u"): "not_ready", ("none", "u"): "not_found"}
    assert [r.id for r in catalogue.list_reviews(reviews, "p", "u").collect()] == ["b", "a"]
    assert [r.id for r in catalogue.list_repositories(repositories, "u").collect()] == ["t", "p", "q"]
    assert sorted(r.id for r in catalogue.latest_reviews(reviews).collect()) == ["b", "c", "d"]
    assert sorted(r.id for r in catalogue.latest_reviews(reviews, by_type=True).collect()) == ["a", "b", "c", "d"]
    board = {r.user_id: tuple(r)[1:] for r in catalogue.dashboard(repositories, reviews).collect()}
    assert board == {"u": (3, 2, 9), "v": (1, 0, 0)}


def test_positions_equal_a_sorted_list(spark):
    """A key with most of the rows lies in several ranges; so does one with equal values."""
    df = spark.range(3000).selectExpr("if(id % 10 < 8, 'hot', concat('k', id % 50)) as k", "if(id % 3 = 0, 7, (id * 7919) % 97) as v", "id", "'x' as _key")
    df = df.unionByName(spark.createDataFrame([(None, 1, 5000, "x"), (None, 2, 5001, "x")], "k string, v long, id long, _key string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = joins.position_within(df, ["k"], [F.desc("v"), F.asc("id")])
        rows = placed.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.columns == [*df.columns, "position"] and "Window" not in placed._jdf.queryExecution().toString()
    for k in {r.k for r in rows}:
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.v, r.id) for r in mine] == sorted(((r.v, r.id) for r in mine), key=lambda x: (-x[0], x[1]))
    assert joins.position_within(df.where("false"), ["k"], [F.desc("v")]).count() == 0


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner", "left"])
def test_hot_keys_are_spread_as_far_as_they_need(spark, how):
    """Half of the rows have one key: it takes more than 16 tasks; the rest, and a table without, no salt."""
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id % 4000)) as review_id", "id as file_path")
    rows = rows.unionByName(spark.createDataFrame([(None, 1)], "review_id string, file_path long"))
    keys = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "review_id string, v int")
    keys = keys if how in ("inner", "left") else keys.select("review_id")
    plain = sorted(map(str, rows.join(keys, "review_id", how).collect()))
    joined = joins.spread_join(rows, keys, ["review_id"], ["file_path"], how, rows_per_task=500)
    assert "Generate" in joined._jdf.queryExecution().toString() and sorted(map(str, joined.collect())) == plain
    assert [(r.review_id, r._salts) for r in joins.hot_keys(rows, ["review_id"], 500).collect()] == [("hot", 20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        if how != "left_anti":
            tasks = joined.where("review_id = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(tasks) > 14 and max(r["count"] for r in tasks) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    cool = joins.spread_join(rows, keys, ["review_id"], ["file_path"], how, rows_per_task=50_000)
    assert "Generate" not in cool._jdf.queryExecution().toString() and sorted(map(str, cool.collect())) == plain
