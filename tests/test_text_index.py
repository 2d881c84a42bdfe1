import random

import pytest
from pyspark.sql import functions as F

from lintmill.operators import search
from lintmill.operators.text_index import TextIndex, _gram_bucket, like_parts
from lintmill.sources.runs import review_bucket

WORDS = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "straße", "100%", "a_b", "x\\y", "İstanbul", "ΣΑΣ", "ab", ""]


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    rnd = random.Random(5)
    rows = [(f"r{i}", " ".join(rnd.choices(WORDS, k=4))) for i in range(150) for _ in range(rnd.randint(0, 4))]
    rows += [("r0", None)]
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    texts = spark.createDataFrame(rows, "review_id string, text string")
    ids = spark.createDataFrame([(f"r{i}",) for i in range(150)], "review_id string")
    index.append(texts.where(F.col("text").isNotNull()), ids)
    return index, texts, ids


def test_like_parts():
    assert like_parts("%ab_c%") == ["ab", "c"] and like_parts(r"%a\%b\_c\\%") == [r"a%b_c\\"[:-1]]
    assert like_parts("%%") == [] and like_parts("") == []


@pytest.mark.parametrize("q", ["alpha", "ALPHA b", "été", "stra_e", "100\\%", "a\\_b", "x\\\\y", "gam%eta", "σας", "istanbul", "i̇st", "nowhere", "beta  "])
def test_equals_a_scan(spark, filed, q):
    index, texts, _ = filed
    pattern = search._like_pattern(q)
    found = index.matching(pattern)
    expected = {r.review_id for r in texts.where(F.col("text").ilike(pattern)).collect()}
    assert {r.review_id for r in found.collect()} == expected


def test_short_patterns_need_a_scan(filed):
    index, _, _ = filed
    assert index.matching("%ab%") is None and index.matching("%a_b_c%") is None and index.matching("%%") is None


def test_only_matching_buckets_are_read(spark, filed, tmp_path):
    index, texts, ids = filed
    few = TextIndex(spark, str(tmp_path))
    rare = texts.where(F.col("text").isNotNull()).unionByName(spark.createDataFrame([("r7", "a needle here")], "review_id string, text string"))
    few.append(rare, ids)
    found = few.matching("%needle%")
    assert [r.review_id for r in found.collect()] == ["r7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("review_bucket") and any("PartitionFilters: [" in line and "review_bucket" in line for line in plan.splitlines())
    assert found.inputFiles() and all("/review_bucket=" in f or "/postings/" in f or "/runs/" in f for f in found.inputFiles())


def test_a_later_run_replaces_texts(spark, filed):
    index, texts, ids = filed
    index.append(spark.createDataFrame([("r1", "second thoughts")], "review_id string, text string"), ids.where("review_id in ('r1', 'r2')"))
    assert [r.review_id for r in index.matching("%thoughts%").collect()] == ["r1"]
    left = {r.review_id for r in index.matching("%alpha%").collect()}
    expected = {r.review_id for r in texts.where(F.col("text").ilike("%alpha%")).collect()} - {"r1", "r2"}
    assert left == expected


def test_postings_are_numbers_of_reviews_in_segments(spark, tmp_path):
    """Each gram of a segment is one row and no review is named in it, however often a text comes."""
    index = TextIndex(spark, str(tmp_path))
    texts = spark.createDataFrame([(f"r{i}", f"same Title {i % 3}") for i in range(40) for _ in range(3)] + [(None, "same")], "review_id string, text string")
    index.append(texts, texts.select("review_id").distinct())
    rows = spark.read.parquet(f"{tmp_path}/postings").collect()
    assert {r.review_id for r in index.matching("%title 2%").collect()} == {f"r{i}" for i in range(2, 40, 3)}
    reviews = {r.segment: r.reviews for r in rows if r.gram is None}
    filed = [(r.segment, r.gram) for r in rows if r.gram is not None]
    assert len(filed) == len(set(filed)) and all(r.gram_bucket == -1 for r in rows if r.gram is None)
    same = sorted(reviews[r.segment][k] for r in rows if r.gram == "sam" for k in r.numbers)
    assert same == sorted(f"r{i}" for i in range(40))


def test_segments_of_many_reviews_and_odd_letters():
    import pyarrow as pa

    from lintmill.operators import text_index as t

    def postings(batches):
        found = [r for b in batches for r in b.to_pylist()]
        names = {r["segment"]: r["reviews"] for r in found if r["gram"] is None}
        return {(r["gram"], names[r["segment"]][k]) for r in found if r["gram"] is not None for k in r["numbers"]}

    words = ["ab", "", "a\0\0b", "été😀x", "x" * 50, "straße", "日本語の文"]
    ids, texts = [f"r{i // 3}" for i in range(600)], [words[i % 7] + words[i % 5] for i in range(600)]
    expected = {(x[j : j + 3], r) for r, x in zip(ids, texts, strict=True) for j in range(len(x) - 2)}
    assert postings(t._segment(5, pa.array(ids), pa.array(texts))) == expected
    broken = pa.array([b"ab\xffcde"]).view(pa.string())
    assert ("cde", "r") in postings(t._segment(5, pa.array(["r"]), broken))


def test_postings_from_before_there_were_segments(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    texts = spark.createDataFrame([("r1", "needle one"), ("r2", "needle two")], "review_id string, text string")
    index.append(texts, texts.select("review_id"))
    old = spark.createDataFrame([("old", "a needle")], "review_id string, text string")
    index.append(old.limit(0), old.select("review_id"))
    run = index._last().where("review_id = 'old'").first().run
    bucket = spark.createDataFrame([("old",)], "id string").select(review_bucket(F.col("id")).alias("b")).first().b
    old.select("*", F.lit(bucket).alias("review_bucket"), F.lit(run).alias("run")).write.mode("append").partitionBy("review_bucket", "run").parquet(f"{tmp_path}/texts")
    grams = spark.createDataFrame([(g, "old") for g in ("nee", "eed", "edl", "dle")], "gram string, review_id string")
    grams = grams.select("*", _gram_bucket(F.col("gram")).alias("gram_bucket"), F.lit(run).alias("run"))
    grams.write.mode("append").partitionBy("gram_bucket", "run").parquet(f"{tmp_path}/postings")
    assert sorted(r.review_id for r in index.matching("%needle%").collect()) == ["old", "r1", "r2"]


def test_batches_of_long_texts_are_cut(monkeypatch):
    import pyarrow as pa

    from lintmill.operators import text_index as t

    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(t, "TaskContext", Task)
    monkeypatch.setattr(t, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(t, "SEGMENT_REVIEWS", 7)
    ids, texts = [f"r{i}" for i in range(60)], [chr(97 + i % 26) * (i + 3) for i in range(60)]
    found = [r for b in t._segments(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["review_id", "text"])])) for r in b.to_pylist()]
    names = {r["segment"]: r["reviews"] for r in found if r["gram"] is None}
    assert len(names) > 5 and max(map(len, names.values())) <= 7 and min(names) == 3 << 32
    filed = sorted((r["gram"], names[r["segment"]][k]) for r in found if r["gram"] is not None for k in r["numbers"])
    assert filed == sorted((x[:3], r) for r, x in zip(ids, texts, strict=True))
