from lintmill.operators.python_facts import facts_of, python_facts
from lintmill.operators.python_rules import parser_failures, python_issues


def rules(files, *sources):
    df = files(*[(f"{i}.py", s) for i, s in enumerate(sources)])
    rows = python_issues(python_facts(df)).collect()
    return sorted((r.file_path, r.rule_id, r.line_start, r.line_end) for r in rows)


def test_broken_source_gives_one_issue(files):
    assert rules(files, "def f(:\n  pass\n") == [("0.py", "python-syntax-error", 1, 1)]


def test_eval_and_docstrings(files):
    source = '"""M."""\n\ndef documented():\n    """D."""\n\ndef bare():\n    return eval("1")\n'
    assert rules(files, source) == [
        ("0.py", "missing-function-docstring", 6, 6),
        ("0.py", "python-eval-exec", 7, 7),
    ]


def test_imports(files):
    source = (
        '"""M."""\nfrom __future__ import annotations\nimport os.path, sys as s\nfrom a import *\n'
        "from b import c, d as e\nimport __future__\n__all__ = ['c']\nprint(os, e)\n"
    )
    df = files(("m.py", source))
    rows = python_issues(python_facts(df)).collect()
    assert sorted(r.title.split("'")[1] for r in rows) == ["annotations", "c", "s"]
    assert {(r.rule_id, r.line_start, r.line_end) for r in rows} == {("unused-import", 1, 1)}


def test_names_privacy_and_spans(files):
    source = (
        '"""M."""\n@deco\ndef ab(): "doc"\n\nasync def z():\n  "d"\n\ndef _p(): pass\n\ndef __q__(): pass\n'
        "class _C:\n    def Ab(self): pass\n"
    )
    assert rules(files, source) == [
        ("0.py", "missing-class-docstring", 11, 11),
        ("0.py", "missing-function-docstring", 12, 12),
        ("0.py", "short-function-name", 3, 3),
        ("0.py", "short-function-name", 5, 6),
    ]


def test_length_limit(files):
    def body(n):
        return '"""M."""\ndef work():\n  "d"\n' + "  x = 1\n" * (n - 2)

    assert rules(files, body(50), body(51)) == [("1.py", "long-function", 2, 52)]


def test_complexity_counts_the_whole_subtree(files):
    outer = (
        '"""M."""\ndef outer():\n  "d"\n' + "  if a: pass\n" * 4 + "  def inner():\n    'd'\n"
        + "    while a and b and c: pass\n    with a: pass\n"
        + "  try: pass\n  except E: pass\n  x = [i for i in y if i]\n  z = 1 if a else 2\n"
    )
    # 1 + 4 if + while + 2 operators + with + except = 10
    assert rules(files, outer) == []
    assert rules(files, outer + "  for i in y: pass\n") == [("0.py", "high-cyclomatic-complexity", 2, 16)]


def test_shell(files):
    source = (
        '"""M."""\nimport subprocess\nsubprocess.run("x", shell=True)\nsubprocess.Popen("x", shell=True)\n'
        'subprocess.call("x", shell=1)\nrun("x", shell=True)\nsubprocess.call("x", shell=True)\na.eval(1)\n'
    )
    assert rules(files, source) == [
        ("0.py", "subprocess-shell-true", 3, 3),
        ("0.py", "subprocess-shell-true", 7, 7),
    ]


def test_blank_docstring_and_other_languages(files):
    assert rules(files, '"""  """\n') == [("0.py", "missing-module-docstring", 1, 1)]
    df = files(("a.js", "eval(1)"))
    assert python_facts(df).count() == 0


def test_parser_failure_is_a_fact(files):
    deep = "x = " + "-" * 200_000 + "1\n"
    kinds = {f["kind"] for f in facts_of(deep)}
    assert kinds <= {"syntax_error", "parser_failure"} and kinds
    facts = python_facts(files(("a.py", deep), ("b.py", "x = 1\n")))
    assert parser_failures(facts).count() in (0, 1)


def test_facts_are_made_in_arrow_and_all_names_count(spark):
    """No frame of objects in between; names stand in aliases, patterns, decorators and format parts as well."""
    from lintmill.operators.python_facts import python_facts

    text = "import a, b, c, d, e, X, z\ntype X = a\nmatch b:\n    case c(): pass\n@d\ndef f(): return f'{e!r}'\n"
    files = spark.createDataFrame([("r", "a.py", "python", text)], "review_id string, file_path string, language string, content string")
    facts = python_facts(files)
    assert "MapInArrow" in facts._jdf.queryExecution().executedPlan().toString()
    [module] = facts.where("kind = 'module'").collect()
    assert module.imported == ["X", "a", "b", "c", "d", "e", "z"] and module.used == ["X", "a", "b", "c", "d", "e"]


ODD_MODULES = [
    "",
    "x = 1\n",
    "# text\n'''Doc.'''\n",
    '"""Doc."""',
    '"""Doc.""" ; x = 1\n',
    '"""Doc.""".strip()\n',
    '"""Doc."""\\\n"more"\n',
    '"""Doc."""\ndef f(:\n',
    '"Doc."\r\ndef \\\r\nab(): pass\r\n',
    '"""  """\nclass \\\n  C: pass\n',
    "def\tz(): pass\ndef\\\n\\\nyy(a): pass\ndef abc(): 'd'\ndef _x(): pass\ndef __y(): pass\n",
    "ｅval('1')\nimport subprocess as ｓ\nｓubprocess.ｒun('x', ｓhell=True)\ndef ａb(): pass\n",
    "f = f'{eval(1)}'\nsubprocess \\\n . call('x', shell=(True))\nsubprocess.run('x', shell = 1)\n",
    "a.subprocess.run('x', shell=True)\nexec('eval')\n",
    "def far(a):\r  'd'\r" + "  a += 1\r" * 49,
    "def near(a):\n  'd'\n" + "  a += 1\n" * 48,
    "async \\\ndef far(a):\n" + "  a += 1\n" * 49,
    "def words(a):\n  return " + "1or " * 10 + "a\n",
    "def words(a):\n  return " + "1or " * 9 + "a\n",
    "if a:\n  pass\nelse:\n  try: pass\n  except E:\n    class K:\n      def ab(self): pass\n",
    "match a:\n  case 1:\n    with b:\n      def cd(): return lambda: eval('1')\n",
    "from __future__ import a\nimport b.c, d as e\nprint(e)\n",
]


def test_facts_for_one_rule_give_its_issues(files):
    from lintmill.operators.python_facts import _NEEDS

    df = files(*[(f"{i}.py", text) for i, text in enumerate(ODD_MODULES)])

    def issues(rules, asked=None):
        rows = [r.asDict() for r in python_issues(python_facts(df, asked)).collect()]
        return sorted(tuple(r.values()) for r in rows if r["rule_id"] in rules)

    every = issues(set(_NEEDS))
    place = python_issues(python_facts(df)).columns.index("rule_id")
    whole = {rule: [r for r in every if r[place] == rule] for rule in _NEEDS}
    assert all(whole.values())
    for rule, rows in whole.items():
        assert issues({rule}, {rule}) == rows, rule
    two = {"missing-class-docstring", "high-cyclomatic-complexity"}
    assert issues(two, two) == [r for r in every if r[place] in two]


def test_texts_that_cannot_break_a_rule_are_not_parsed(monkeypatch):
    import ast

    parsed = []
    parse = ast.parse
    monkeypatch.setattr(ast, "parse", lambda text: parsed.append(text) or parse(text))
    plain = '"""Doc."""\ndef work(a):\n  "d"\n  subprocess.run("x", shell=False)\n'
    rules = ["missing-module-docstring", "short-function-name", "long-function", "high-cyclomatic-complexity",
             "missing-class-docstring", "python-eval-exec", "subprocess-shell-true", "unused-import"]
    assert facts_of(plain, rules) == [] and parsed == []
    assert [f["kind"] for f in facts_of(plain, ["missing-function-docstring"])] == ["function"]
    assert facts_of(plain, ["python-syntax-error"]) == [] and len(parsed) == 2
    assert {f["kind"] for f in facts_of(plain)} == {"function", "call", "module"}
