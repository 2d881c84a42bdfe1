import pytest
from oracle import compare

from lintmill.llm.oracles import ORACLES


@pytest.mark.parametrize("name", ORACLES)
def test_agrees_with_sql(spark, given, name):
    compare(spark, given, name)


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op4_quality_rules"])
def test_agrees_with_sql_on_odd_rows(spark, docs, tmp_path, name):
    loop = "one two three four five six seven eight nine ten "
    rows = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "a b c"), (4, "a b a b a b " * 30), (5, loop + "x " + loop), (6, "É é A\u00a0B z\x1fy " * 40),
            (7, "same line here\nsame line here\n\n \nx"), (8, "the The THE the"), (9, "##$$ %% && " * 30), (10, "w " * 2000)]
    docs(rows, False).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, loop.upper()), (2, "the the"), (3, None), (4, "..."), (5, "Z"), (6, loop + "x"), (7, "É é a")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in ("documents", "benchmark"):
        files = list((tmp_path / f"{table}.parquet").glob("*.parquet"))
        files[0].rename(tmp_path / "x.parquet")
        for rest in (tmp_path / f"{table}.parquet").iterdir():
            rest.unlink()
        (tmp_path / f"{table}.parquet").rmdir()
        (tmp_path / "x.parquet").rename(tmp_path / f"{table}.parquet")
    compare(spark, str(tmp_path), name)


def test_odd_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.com/de/1", "x://b.example.com:80/de/", "http://x.org/fr/", "http://org/fr/1",
            "http://net", "http://net/", "http://a.net?q=://b", "http://notnet/", "ftp://u@h.co.uk/p/#f", "http://h.co.uk/", "http://x.org/fr/", "http://a..net/", "http://ÄB.net/Ä"]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls + urls[-3:])]
    spark.createDataFrame(rows, "page_id long, url string, host string, _rule string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(spark, str(tmp_path), "op3_url_filters")
