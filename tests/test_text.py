import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from lintmill.functions import text

ENDS = ["\n", "\r\n", "\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lines_equal_splitlines(spark):
    rng = random.Random(1)
    texts = ["", "\n", "\n\n", "a", "a\n", "a\r\nb", "a\r", "é\x85b", *ENDS]
    texts += ["".join(rng.choice(["a", "b ", "", "x1", *ENDS]) for _ in range(rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    rows = {r.i: r.lines for r in text.with_lines(df).collect()}
    assert [rows[i] for i in range(len(texts))] == [t.splitlines() for t in texts]
    assert column(spark, texts, text.line_count) == [len(t.splitlines()) for t in texts]
    exploded = text.explode_lines(df, "i").orderBy("i", "line_no").collect()
    expected = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines(), 1)]
    assert [tuple(r) for r in exploded] == expected


def test_strip_equals_python(spark):
    values = [" a ", "\t\xa0a\u3000", "\x1fa\x1f", "a\nb\n", "\x85", "", "\u200ba\u200b", "\ufeffa"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_paths(spark):
    names = [".py", "..py", "foo.", "a.b/c", "x.PY", "a/b.min.js", "d.d/e.TSX", "noext", "a/.hidden.go"]
    suffixes = column(spark, names, text.suffix)
    assert suffixes == ["", ".py", "", "", ".py", ".js", ".tsx", "", ".go"]
    assert column(spark, names, text.language_of)[4:7] == ["python", "javascript", "typescript"]
    paths = ["a/b.py", "a.py", "a/b/c.py", "a-b/c.py", "a", "a b/c", "A/z", "a/b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(text.path_key(F.col("p")))
    assert [r.p for r in df.collect()] == [str(p) for p in sorted(PurePosixPath(p) for p in paths)]


def test_decode_replaces_and_normalises(spark):
    raws = [b"ok\r\nx\ry", b"\xff\xfe", b"\xe2\x82", b"a\xc3(b", "é".encode()]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")
    got = [r.x for r in df.select("i", text.decode(F.col("raw")).alias("x")).orderBy("i").collect()]
    wanted = [r.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for r in raws]
    assert got == wanted


def test_csv_list(spark):
    assert column(spark, ["a, b ,,c", "", " , "], text.csv_list) == [["a", "b", "c"], [], []]
