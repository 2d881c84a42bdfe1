from pyspark.sql import functions as F

from lintmill.operators.duplicates import duplicate_issues, repeated_blocks, shingles
from lintmill.operators.line_rules import broken_rules, large_file_issues, line_issues
from lintmill.operators.long_functions import function_spans, long_function_issues, overlong_functions, spans_of
from lintmill.operators.scoring import line_counts
from lintmill.operators.text_scan import blocks, braces, counted_lines, large_files, lines_with_hits, scan_texts
from lintmill.plans.static_review import Scanned, all_issues, scored_files
from lintmill.session import written

TEXTS = {
    "a.js": "var a = 1\n# TODO no\n// TODO yes\n" + "x\n" * 5 + "é" * 121,
    "b.ts": "function f(a) {\n" + "  a += 1;\n" * 60 + "}\n" + "if (a) {\n" * 3 + "x;\n" * 70,
    "short.js": "function g() {\n}\n",
    "empty.py": "",
    "newline.py": "\n",
    "c.go": "\n" * 501,
    "d.go": "fmt.Println(1)\r\nx\x0cy z",
    "e.rs": "x.unwrap()\n" * 9,
    "f.unknown": "TODO var eval(\n" * 600,
    "g.py": "import os\n# c\n// d\n\n\nx = 1\n",
}


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_one_pass_finds_what_each_rule_finds(spark, files):
    df = files(*TEXTS.items(), *[(f"r{i}", f"x{i % 3}.js", TEXTS["a.js"]) for i in range(4)])
    texts = written(scan_texts(df), "texts")
    assert rows(broken_rules(lines_with_hits(texts))) == rows(line_issues(df))
    assert rows(large_files(texts)) == rows(large_file_issues(df))
    assert rows(overlong_functions(spans_of(braces(texts)))) == rows(long_function_issues(df))
    assert rows(spans_of(braces(texts))) == rows(function_spans(df, 51))
    assert rows(counted_lines(texts)) == rows(line_counts(df))
    assert rows(blocks(texts)) == rows(shingles(df))
    assert rows(repeated_blocks(blocks(texts))) == rows(duplicate_issues(df))
    scanned = Scanned(df)
    issues = all_issues(scanned)
    assert scored_files(scanned, issues).count() == df.count() and issues.where("rule_id = 'large-file'").count() == 1


def test_texts_are_read_once(files, spark, tmp_path):
    """Besides the Python parser's, one scan of the corpus stands behind all detectors."""
    files(*TEXTS.items()).write.parquet(str(tmp_path / "corpus"))
    scanned = Scanned(spark.read.parquet(str(tmp_path / "corpus")))
    results = scored_files(scanned, all_issues(scanned))
    plan = results._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and results.count() == len(TEXTS)
    scan = scan_texts(spark.read.parquet(str(tmp_path / "corpus")))._jdf.queryExecution().executedPlan().toString()
    assert scan.count("FileScan") == 1 and scan.count("split(") <= 2 and "Exchange" not in scan


def test_single_blocks_are_not_shuffled(spark, monkeypatch):
    """Of blocks that occur once only marks are moved; with one word for all bits some slip through, with the same result."""
    unique = [("r", f"f{i}", 1, bytes([i % 251, i // 251]) * 16) for i in range(2000)]
    twice = [(r, p, 7, b"same" * 8) for r in ("r", "s") for p in ("b", "a", "c")]
    frame = written(spark.createDataFrame(unique + twice, "review_id string, file_path string, line_start int, fingerprint binary"), "blocks")
    from lintmill.operators import duplicates

    kept = duplicates._of_repeated(frame)
    assert sorted({(r.review_id, r.file_path) for r in kept.collect()} & {(r, p) for r, p, *_ in twice}) == sorted((r, p) for r, p, *_ in twice)
    assert kept.count() <= 10
    found = rows(repeated_blocks(frame))
    monkeypatch.setattr(duplicates, "SLOTS", 1)
    assert duplicates._of_repeated(frame).count() >= 6 and rows(repeated_blocks(frame)) == found and len(found) == 2
    assert repeated_blocks(frame.where(F.lit(False))).count() == 0
