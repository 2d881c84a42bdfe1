"""Facts about Python sources, one Arrow pass over the Python files.

Parsing is the one thing no built-in expression can do.  The function below
states facts only; what counts as an issue is decided by ``python_rules``.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Collection, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.operators.rule_catalog import MAX_COMPLEXITY, MAX_FUNCTION_LINES

FACTS_SCHEMA = """
    review_id string, file_path string, kind string, name string,
    line_start int, line_end int, has_docstring boolean, complexity int,
    shell_true boolean, message string, imported array<string>, used array<string>
"""
_FACT_FIELDS = [
    "kind",
    "name",
    "line_start",
    "line_end",
    "has_docstring",
    "complexity",
    "shell_true",
    "message",
    "imported",
    "used",
]

# The calls some rule asks about, and what adds a branch.
WATCHED_CALLS = {"eval", "exec", "subprocess.run", "subprocess.call"}
_BRANCHES = {ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith}
_FUNCTIONS = {ast.FunctionDef, ast.AsyncFunctionDef}
# Fields that may hold nodes, by type of node. Types without any, constants, and names, which are not entered, are left out.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "asname", "module", "level", "kind", "type_comment", "type_ignores", "conversion", "simple", "is_async", "tag"}
_CHILDREN = {
    t: tuple(f for f in t._fields if f not in _PLAIN)
    for t in vars(ast).values()
    if isinstance(t, type) and issubclass(t, ast.AST) and t not in (ast.Name, ast.Constant, ast.alias) and set(t._fields) - _PLAIN
}
# The same for statements inside statements: all that rules on functions, classes and docstrings need.
_BLOCKS = {
    t: fields
    for t in _CHILDREN
    if (fields := tuple(f for f in t._fields if f in ("body", "orelse", "finalbody", "handlers", "cases")))
}

_SHORT_NAME = re.compile(r"def[\s\\]+[a-z]{1,2}(?![A-Za-z0-9_])")
_PUBLIC_NAME = re.compile(r"def[\s\\]+[A-Za-z]")
_FIRST_WORD = re.compile("def|async")
_BRANCH_WORD = re.compile("if|for|while|except|with|and|or")
# A string that opens with a letter and is the whole first statement.
_OPENING_STRING = re.compile(r'''(?:"""[A-Za-z][^"\\]*+"""|"[A-Za-z][^"\\\r\n]*+")[ \t]*(?:[\r\n]|\Z)''')


class _Need(NamedTuple):
    """What a rule takes: the kind of its facts, the nodes that are entered for them, and what an ASCII
    text must hold to break it. (Other texts may spell a name in other characters.)"""

    kind: str
    entered: dict[type, tuple[str, ...]]
    may_break: Callable[[str], object]


def _has_many_lines(text: str) -> bool:
    """Whether enough lines end after the first word that may begin a function."""
    first = _FIRST_WORD.search(text)
    return first is not None and text.count("\n", first.start()) + text.count("\r", first.start()) >= MAX_FUNCTION_LINES


_NEEDS = {
    "python-syntax-error": _Need("syntax_error", {ast.Module: ()}, lambda text: True),
    "missing-module-docstring": _Need("module", _BLOCKS, lambda text: not _OPENING_STRING.match(text)),
    "short-function-name": _Need("function", _BLOCKS, _SHORT_NAME.search),
    "long-function": _Need("function", _BLOCKS, _has_many_lines),
    "missing-function-docstring": _Need("function", _BLOCKS, _PUBLIC_NAME.search),
    "high-cyclomatic-complexity": _Need(
        "function", _CHILDREN, lambda text: "def" in text and len(_BRANCH_WORD.findall(text)) >= MAX_COMPLEXITY
    ),
    "missing-class-docstring": _Need("class", _BLOCKS, lambda text: "class" in text),
    "python-eval-exec": _Need("call", _CHILDREN, lambda text: "eval" in text or "exec" in text),
    "subprocess-shell-true": _Need(
        "call",
        _CHILDREN,
        lambda text: "shell" in text and "True" in text and "subprocess" in text and ("run" in text or "call" in text),
    ),
    "unused-import": _Need("module", _CHILDREN, lambda text: "import" in text),
}


def _dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(parts))


def _shell_is_true(call: ast.Call) -> bool:
    return any(
        k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True
        for k in call.keywords
    )


def facts_of(source: str, rules: Collection[str] | None = None) -> list[dict]:
    """The facts of one source text, or of them those that some rules take."""
    if rules is None:
        return _facts_within(source, _CHILDREN)
    needs = [_NEEDS[rule] for rule in rules]
    if source is not None and source.isascii() and not any(n.may_break(source) for n in needs):
        return []
    kinds = {"parser_failure", *(n.kind for n in needs)}
    return [f for f in _facts_within(source, max((n.entered for n in needs), key=len)) if f["kind"] in kinds]


def _facts_within(source: str, entered: dict[type, tuple[str, ...]]) -> list[dict]:
    """The facts at the nodes that are entered. Complexity is stated if those are all."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except SyntaxError as error:
        line = error.lineno or 1
        return [{"kind": "syntax_error", "line_start": line, "line_end": line,
                 "message": error.msg or "invalid syntax"}]
    except (ValueError, RecursionError, MemoryError) as error:
        return [{"kind": "parser_failure", "line_start": 1, "line_end": 1,
                 "message": str(error) or type(error).__name__}]

    imported: set[str] = set()
    used: set[str] = set()
    facts: list[dict] = []
    functions: list[tuple[dict, int]] = []  # fact, index of the enclosing function
    branches: list[int] = []  # per function, without the functions inside it
    pending: list[tuple[ast.AST, int]] = [(tree, -1)]
    while pending:
        node, owner = pending.pop()
        kind = type(node)
        if kind in _BRANCHES:
            if owner >= 0:
                branches[owner] += 1
        elif kind is ast.BoolOp:
            if owner >= 0:
                branches[owner] += len(node.values) - 1
        elif kind is ast.Call:
            name = _dotted(node.func)
            if name in WATCHED_CALLS:
                facts.append({"kind": "call", "name": name, "line_start": node.lineno,
                              "line_end": node.lineno, "shell_true": _shell_is_true(node)})
        elif kind in _FUNCTIONS:
            fact = {"kind": "function", "name": node.name, "line_start": node.lineno,
                    "line_end": node.end_lineno, "has_docstring": bool(ast.get_docstring(node))}
            functions.append((fact, owner))
            branches.append(0)
            owner = len(functions) - 1
        elif kind is ast.ClassDef:
            facts.append({"kind": "class", "name": node.name, "line_start": node.lineno,
                          "line_end": node.end_lineno,
                          "has_docstring": bool(ast.get_docstring(node))})
        elif kind is ast.Import:
            imported.update(a.asname or a.name.partition(".")[0] for a in node.names)
        elif kind is ast.ImportFrom:
            imported.update(a.asname or a.name for a in node.names if a.name != "*")
        for field in entered[kind]:
            value = getattr(node, field)
            if value is None:
                continue
            if type(value) is list:
                for item in value:
                    inner = type(item)
                    if inner is ast.Name:
                        used.add(item.id)
                    elif inner in entered:
                        pending.append((item, owner))
            else:
                inner = type(value)
                if inner is ast.Name:
                    used.add(value.id)
                elif inner in entered:
                    pending.append((value, owner))

    # An inner function comes after its outer one, whose branches include its own.
    for i in range(len(functions) - 1, -1, -1):
        fact, outer = functions[i]
        if outer >= 0:
            branches[outer] += branches[i]
        if entered is _CHILDREN:
            fact["complexity"] = branches[i] + 1
        facts.append(fact)
    facts.append({"kind": "module", "line_start": 1, "line_end": 1,
                  "has_docstring": bool(ast.get_docstring(tree)),
                  "imported": sorted(imported), "used": sorted(used & imported)})
    return facts


FRAME_ROWS = 20_000


_TEXTS = pa.list_(pa.string())
_BATCH = pa.schema(
    [(c, pa.string()) for c in ("review_id", "file_path", "kind", "name")]
    + [("line_start", pa.int32()), ("line_end", pa.int32()), ("has_docstring", pa.bool_()), ("complexity", pa.int32())]
    + [("shell_true", pa.bool_()), ("message", pa.string()), ("imported", _TEXTS), ("used", _TEXTS)]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_BATCH)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BATCH, strict=True)], schema=_BATCH)


def _facts_of_batches(batches: Iterator[pa.RecordBatch], rules: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Facts in batches of about FRAME_ROWS rows, however large a batch of files is."""
    rows: list[tuple] = []
    for batch in batches:
        for review_id, path, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows += [(review_id, path, *map(fact.get, _FACT_FIELDS)) for fact in facts_of(source, rules)]
            if len(rows) >= FRAME_ROWS:
                yield _batch(rows)
                rows = []
    yield _batch(rows)


def python_facts(files: DataFrame, rules: Collection[str] | None = None) -> DataFrame:
    """One row per fact; ``used`` holds those imported names that occur as identifiers.

    With ``rules`` only the facts that these rules take, so that ``python_issues`` finds the same issues of them:
    every text is searched for words without which none of them can be broken, and parsed if it has them. What
    breaks the parser itself is known of all files only without ``rules``.

    Files are parsed where they are read: no text is shuffled.  Parsing costs more per
    byte than reading, so a job over Python text alone does well with small scan splits
    (``spark.sql.files.maxPartitionBytes``); Spark bounds an Arrow batch by its bytes.
    """
    sources = files.where(F.col("language") == "python").select("review_id", "file_path", "content")
    if rules is None:
        return sources.mapInArrow(_facts_of_batches, FACTS_SCHEMA)
    return sources.mapInArrow(partial(_facts_of_batches, rules=sorted(rules)), FACTS_SCHEMA)
