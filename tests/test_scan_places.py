import hashlib
import sys
from random import Random

import pyarrow as pa
from pyspark.sql import functions as F

from lintmill.operators import text_scan
from lintmill.operators.duplicates import duplicate_issues, repeated_blocks, shingles
from lintmill.operators.line_rules import broken_rules, large_file_issues, line_issues
from lintmill.operators.long_functions import long_function_issues, overlong_functions, spans_of
from lintmill.operators.rule_catalog import COMMON_RULES, LANGUAGE_RULES
from lintmill.operators.scoring import line_counts
from lintmill.operators.text_scan import blocks, braces, counted_lines, large_files, lines_with_hits, scan_texts
from lintmill.plans.static_review import Scanned
from lintmill.session import written

SPACES = "\t\x0b\x1f \x85\xa0\u1680\u2000\u2028\u202f\u205f\u3000"
TEXTS = [
    ("long.go", "x\n" * 3000),
    ("same/a.js", "let a = 1\nlet b = 2\nlet c = 3\nlet d = 4\n" * 3),
    ("same.js", "let z\n  let a = 1  \r\n\tlet b = 2\x0clet c = 3\x1clet d = 4 \n\n"),
    ("spaces.rs", "\n".join(f"{c}x.unwrap(){c}y{c}" for c in SPACES) * 2),
    ("comments.py", "# a\n// b\n\n  # c\n" * 4 + "'api_key'='12345678'\nTOKEN = \"abcdefgh\"\n"),
    ("wide.cs", "é" * 120 + "\n" + "é" * 121 + "\n" + "\U0001f600" * 121 + "\nstatic Console.Write(1)"),
    ("f.ts", "const f = (a) =>\n{\n" + "  a += 1\n" * 60 + "}\nfunction\ng()\n" + "function h(a) {\n" + "b;\n" * 70),
    ("none", "TODO\n" * 600),
    ("empty.py", ""),
    ("end.py", "\n"),
    ("null.js", None),
]


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_two_places_of_a_block_are_enough(spark, files):
    """A scan that leaves out what no rule asks for finds what each rule finds by itself."""
    df = files(*TEXTS, *[("other", p, t) for p, t in TEXTS if t], *TEXTS[:3])
    texts = written(scan_texts(df, places=2), "texts")
    known = df.where("content is not null")
    assert rows(broken_rules(lines_with_hits(texts))) == rows(line_issues(known))
    assert rows(large_files(texts)) == rows(large_file_issues(known))
    assert rows(overlong_functions(spans_of(braces(texts)))) == rows(long_function_issues(known))
    assert rows(counted_lines(texts)) == rows(line_counts(df))
    assert rows(repeated_blocks(blocks(texts))) == rows(duplicate_issues(known))
    assert rows(blocks(scan_texts(df))) == rows(shingles(known))


def test_rows_grow_with_different_blocks(spark, files):
    """A text of equal lines becomes as many rows as a block has places, however long it is."""
    scanned = Scanned(files(*[("r", f"{n}.go", "x\n" * n) for n in (100, 1000, 5000)]))
    assert scanned.texts.count() == 6
    assert scanned.texts.where(F.col("n_lines") == 5000).count() == 2


def as_batch(texts, languages):
    names = [str(n) for n in range(len(texts))]
    columns = [pa.array(c, pa.string()) for c in (["r"] * len(texts), names, languages, texts)]
    return pa.RecordBatch.from_arrays(columns, names=["review_id", "file_path", "language", "content"])


def by_line(text, language, places, size=4):
    """What ``_cut`` gives for a file, one line at a time."""
    lines = text.splitlines() if text else []
    times, kept = {}, {0: None} if lines else {}
    for at in range(len(lines) - size + 1):
        block = tuple(line.strip() for line in lines[at : at + size])
        times[block] = times.get(block, 0) + 1
        if times[block] <= places and not all(line == "" or line.startswith(("//", "#")) for line in block):
            kept[at] = hashlib.sha256("\n".join(block).encode()).digest()
    needles = [n for rule in [*COMMON_RULES, *LANGUAGE_RULES.get(language, [])] for n in rule.needles]
    if language in ("javascript", "typescript") and len(lines) > 50:
        needles += ["{", "}", "function", "=>"]
    known = language in LANGUAGE_RULES
    asked = {at for at, line in enumerate(lines) if known and (len(line) > 120 or any(n in line for n in needles))}
    every = range(len(lines)) if places > len(lines) else sorted({*kept, *asked})
    n_lines = None if text is None else len(lines)
    return [(n_lines, at + 1, lines[at] if at in asked else None, kept.get(at)) for at in every] or [(n_lines, None, None, None)]


def test_texts_cut_together_give_the_lines_of_each(monkeypatch):
    """Line ends of all kinds, strange spaces, empty and null texts, texts that end anywhere."""
    random = Random(4)
    pieces = ["a", "a", "b = 1", "{", "}", "'k'", "TODO", "eval(", "// c", "# d", "", " ", "\t", "\xa0", "　x\x1f", "\xe9" * 121, "z" * 120, "=>"]
    ends = ["\n"] * 12 + ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "‧", "\xc5", ""]
    texts = [None, "", "\n", "x", "\n", "\r", "\xe9\n" * 3] + [
        "".join(random.choice(pieces) + (random.choice(ends) if n % 3 else "\n") for _ in range(random.choice([1, 3, 9, 80]))) for n in range(400)
    ]
    languages = [random.choice([*LANGUAGE_RULES, "javascript", None, "text"]) for _ in texts]
    for digits in (1 << 62, 1 << 10):  # the numbers of blocks are given anew where they would grow too large
        monkeypatch.setattr(text_scan, "_MOST", digits)
        for places in (1, 2, None):
            rows = text_scan._cut(as_batch(texts, languages), 4, places).to_pylist()
            found = {}
            for row in rows:
                found.setdefault(row["file_path"], []).append((row["n_lines"], row["line_no"], row["line"], row["fingerprint"]))
            for n, (text, language) in enumerate(zip(texts, languages, strict=True)):
                assert found[str(n)] == by_line(text, language, places or 1 << 30), (n, places)


def test_lines_are_not_cut_one_by_one():
    """Calls of functions, built-in ones too, grow with the different blocks that are kept, not with lines."""

    def calls(lines):
        n = 0

        def count(_, event, __):
            nonlocal n
            n += event in ("call", "c_call")

        batch = as_batch(["x = 1\ny = 2\n" * lines] * 3, ["go"] * 3)
        sys.setprofile(count)
        try:
            text_scan._cut(batch, 4, 2)
        finally:
            sys.setprofile(None)
        return n

    calls(10)
    assert calls(5000) < calls(10) + 50
