import hashlib
import random
import re
from collections import defaultdict
from pathlib import PurePosixPath

from lintmill.operators.duplicates import duplicate_issues, shingles
from lintmill.operators.long_functions import function_spans, long_function_issues
from lintmill.operators.rule_catalog import FUNCTION_START


def brute_spans(text):
    lines = text.splitlines()
    for start, line in enumerate(lines):
        match = re.search(FUNCTION_START, line)
        if match:
            depth, seen, end = 0, False, start
            for end in range(start, len(lines)):
                depth += lines[end].count("{") - lines[end].count("}")
                seen = seen or "{" in lines[end]
                if seen and depth <= 0:
                    break
            yield next(g for g in match.groups() if g), start + 1, end + 1


def test_spans_equal_a_scan_from_each_start(files):
    rng = random.Random(7)
    pieces = ["function a() {", "}", "x", "const b = (q) =>", "{", "}}", "if (x) {", "} else if (y) { z }", "f(a) { }",
              "{{", "", "function c()", "};"]
    rows = [(f"{i}.ts", "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    got = sorted((r.file_path, r.name, r.line_start, r.line_end) for r in function_spans(files(*rows)).collect())
    assert got == sorted((path, *span) for path, text in rows for span in brute_spans(text))


def test_long_function_limit(files):
    def body(n):
        return "function f() {\n" + "x\n" * (n - 2) + "}\n"

    df = files(("a.js", body(50)), ("b.js", body(51)), ("c.java", body(80)), ("d.js", "function f() {\n" + "x\n" * 60))
    rows = sorted((r.file_path, r.line_start, r.line_end) for r in long_function_issues(df).collect())
    assert rows == [("b.js", 1, 51), ("d.js", 1, 61)]


def brute_duplicates(rows):
    places = defaultdict(list)
    for review, path, text in sorted(rows, key=lambda r: (r[0], PurePosixPath(r[1]))):
        lines = [line.strip() for line in text.splitlines()]
        for start in range(len(lines) - 3):
            block = lines[start : start + 4]
            if any(b and not b.startswith(("//", "#")) for b in block):
                digest = hashlib.sha256("\n".join(block).encode()).hexdigest()
                places[review, digest].append((path, start + 1))
    return sorted((review, *p[0], *p[1]) for (review, _), p in places.items() if len(p) > 1)


def duplicates(df):
    rows = []
    for r in duplicate_issues(df).collect():
        other, line = re.search(r"stand in (.*) from line (\d+)\.", r.explanation).groups()
        assert r.line_end == r.line_start + 3
        rows.append((r.review_id, r.file_path, r.line_start, other, int(line)))
    return sorted(rows)


def test_duplicates_equal_a_scan(files):
    rng = random.Random(3)
    rows = [
        (rng.choice("pq"), rng.choice(["a/b", "a", "a-b", "a/b/c"]) + f"/{i}.js",
         "\n".join(rng.choice([" x", "x", "y", "", "// c", "#"]) for _ in range(rng.randrange(12))))
        for i in range(60)
    ]
    assert duplicates(files(*rows)) == brute_duplicates(rows)
    shuffled = files(*rng.sample(rows, len(rows))).repartition(3)
    assert duplicates(shuffled) == brute_duplicates(rows)


def test_short_and_comment_blocks(files):
    df = files(("a.js", "x\ny\nz"), ("b.js", "x\ny\nz"), ("c.js", "//a\n\n#b\n\n//a\n\n#b\n"), ("d.js", "s\ns\ns\ns\ns"))
    assert duplicates(df) == [("r", "d.js", 1, "d.js", 2)]
    assert shingles(df).count() == 2


def test_a_hot_block_is_cut_before_the_shuffle(files):
    plan = duplicate_issues(files(("a.js", "x\n" * 9)))._jdf.queryExecution().executedPlan().toString()
    # Marks are counted and words made of them; of the places only those of repeated blocks are moved, cut before.
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert plan.count("WindowGroupLimit") == 2 and sum("fingerprint" in line for line in exchanges) == 1 and len(exchanges) == 4
