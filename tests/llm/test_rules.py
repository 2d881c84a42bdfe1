from pyspark.sql import functions as F

from lintmill.llm.quality_rules import judge_quality, keep_good
from lintmill.llm.url_filter import domain_of, judge_urls, reputation, suffix_of

GOOD = " ".join(f"word{i}" for i in range(60))


def test_a_bad_source_loses_its_good_documents(spark):
    rows = [(i, GOOD if i % 10 == 0 else "#### $$$$ " * 40, "bad") for i in range(60)] + [(100 + i, GOOD, f"s{i % 5}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in judge_quality(frame).where("kept").collect()}
    assert kept == set(range(100, 160))
    assert {r.doc_id for r in keep_good(frame).collect()} == kept


def test_a_few_failures_do_not_condemn_a_source(spark):
    rows = [(i, "short", "small") for i in range(3)] + [(10, GOOD, "small")] + [(100 + i, GOOD, "other") for i in range(50)]
    kept = {r.doc_id for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {10, *range(100, 150)}


def test_odd_rows_keep_their_columns(docs):
    frame = docs([(1, None), (1, None), (2, GOOD), (None, GOOD), (3, "")])
    kept = keep_good(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    assert judge_quality(frame).count() == 5 and judge_quality(frame.where("false")).count() == 0


def test_reputation_spreads_to_pages_without_a_rule(spark):
    bad = [(i, f"http://h{i % 3}.spam.com/x/{i}") for i in range(90)]
    free = [(1000, "http://h0.spam.com/free/1"), (1001, "http://new.spam.com/free/2"), (1002, "http://ok.fine.org/free/3"), (1003, None), (1004, "http://unseen.info/")]
    good = [(2000 + i, f"http://ok.fine.org/x/{i}") for i in range(60)]
    pages = spark.createDataFrame(bad + free + good, "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages, ["block spam.com/x/", "allow org/x/"]).collect()}
    assert verdicts[1000] == verdicts[1001] == "block" and verdicts[1002] == verdicts[1003] == "allow" and verdicts[0] == "block"
    assert judge_urls(pages.where("false"), ["block net/"]).count() == 0


def test_shrinkage_pulls_small_hosts_to_their_domain(spark):
    rows = [("a.x.com", 1)] * 1 + [("b.x.com", 0)] * 200 + [("c.x.com", 0)] * 100 + [("d.y.com", 1)] * 100 + [("e.y.com", None)] * 2
    rates = {r.host: r.mean for r in reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rates["b.x.com"] < rates["a.x.com"] < 0.9 < rates["d.y.com"] and rates["e.y.com"] > 0.5


def test_domains(spark):
    hosts = ["a.b.example.com", "example.com", "com", "x.shop.co.uk", "co.uk", "", "a..com"]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain_of(F.col("h")), suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in got[:5]] == [("example.com", "com"), ("example.com", "com"), ("com", "com"), ("shop.co.uk", "co.uk"), ("co.uk", "co.uk")]
