import re

import pytest
from pyspark.sql import functions as F

from conformance.views import CODE_LANGUAGES, LANGUAGE_TEMPLATES, templates_of
from lintmill.functions.text import unicode_pattern
from lintmill.operators.line_rules import large_file_issues, line_issues
from lintmill.operators.rule_catalog import COMMON_RULES, FUNCTION_START, LANGUAGE_RULES


def found(issues):
    return sorted((r.file_path, r.line_start, r.rule_id) for r in issues.collect())


@pytest.mark.parametrize("language", CODE_LANGUAGES)
def test_each_template_breaks_its_rules(files, language):
    ending, _ = LANGUAGE_TEMPLATES[language]
    templates = templates_of(language)
    df = files((f"x{ending}", "\n".join(t for t, _ in templates)))
    wanted = sorted((f"x{ending}", n, rule) for n, (_, rules) in enumerate(templates, 1) for rule in rules)
    assert found(line_issues(df)) == wanted


def test_quirks(files):
    df = files(
        ("a.c", "#include <x> // TODO\n  // TODO\n   \t\n"),
        ("b.py", "# TODO\nx = 1  # TODO\n"),
        ("c.txt", "// TODO"),
        ("d.js", "catch (e) {\n}\n"),
        ("e.min.js", "eval(1)"),
        ("f.js", "é" * 121 + "\n" + "é" * 120),
    )
    assert found(line_issues(df)) == [
        ("a.c", 2, "todo-comment"),
        ("b.py", 2, "todo-comment"),
        ("e.min.js", 1, "js-eval"),
        ("f.js", 1, "long-line"),
    ]
    assert found(line_issues(df, {"js-eval"})) == [("e.min.js", 1, "js-eval")]


def test_large_file_counts_blank_lines(files):
    df = files(("a.go", "\n" * 500), ("b.go", "\n" * 501), ("c.go", "x\n" * 500 + "y"), ("d.md", "\n" * 900))
    rows = [(r.file_path, r.line_start, r.line_end) for r in large_file_issues(df).collect()]
    assert sorted(rows) == [("b.go", 1, 501), ("c.go", 1, 501)]


def test_patterns_mean_the_same_as_in_python(spark):
    rules = [*COMMON_RULES, *(r for rs in LANGUAGE_RULES.values() for r in rs)]
    patterns = {r.rule_id: r.pattern for r in rules} | {"function": FUNCTION_START}
    texts = [t for name in CODE_LANGUAGES for t, _ in templates_of(name)]
    texts += [
        "éTODO", "TODO²", "TODO_", "TODO\u0301", "var\xa0vär", "var\x1fx", "var ²", "eval\u2003(", "x.unwrap\x1f()",
        "paſſword = '12345678'", "ſecret='12345678'", "toKen: \"abcdefgh\"", "apİkey='12345678'", "apıkey='12345678'",
        "api-key : 'abcdefgh'", "any: any", "x: anyé", "x:any²", "using namespace std ;", "function é(", "async ü () {",
        "const f = (a, b) =>", "let g=async(x)=>", "if (x) {", "} catch (e) {", "a, _:= f()", "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    columns = [F.col("t").rlike(unicode_pattern(p)).alias(name) for name, p in patterns.items()]
    for row in df.select("i", *columns).collect():
        for name, p in patterns.items():
            assert row[name] == bool(re.search(p, texts[row.i])), (name, texts[row.i])


def test_needles_are_in_every_match():
    for name in CODE_LANGUAGES:
        for rule in [*COMMON_RULES, *LANGUAGE_RULES[name]]:
            for line, _ in templates_of(name):
                if re.search(rule.pattern, line):
                    assert any(n in line for n in rule.needles)


def test_stays_narrow(files):
    plan = line_issues(files(("a.js", "eval(1)")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
