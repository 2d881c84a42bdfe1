"""Python rules as conditions on facts: one narrow pass, one parse of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators.rule_catalog import MAX_COMPLEXITY, MAX_FUNCTION_LINES
from lintmill.schemas import ISSUE_COLUMNS


def _issue(
    rule_id: str,
    category: str,
    severity: str,
    confidence: float,
    title: Column,
    explanation: Column,
    suggestion: str,
    whole: bool = False,
) -> Column:
    return F.struct(
        F.col("line_start").alias("line_start"),
        F.col("line_end" if whole else "line_start").alias("line_end"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        F.lit(rule_id).alias("rule_id"),
        title.alias("title"),
        explanation.alias("explanation"),
        F.lit(suggestion).alias("suggestion"),
    )


def _named(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("name"), F.lit(after))


def python_issues(facts: DataFrame) -> DataFrame:
    kind, name = F.col("kind"), F.col("name")
    is_function = kind == "function"
    # One leading underscore makes a function private; two or more do not.
    checked = is_function & (~name.startswith("_") | name.startswith("__"))
    length = F.col("line_end") - F.col("line_start") + 1
    rules = F.array(
        F.when(
            kind == "syntax_error",
            _issue("python-syntax-error", "bug", "high", 0.99, F.lit("Syntax error"),
                   F.col("message"), "Repair the syntax; the file cannot be run."),
        ),
        F.when(
            (kind == "module") & ~F.col("has_docstring"),
            _issue("missing-module-docstring", "missing_documentation", "low", 0.7,
                   F.lit("Module without docstring"),
                   F.lit("Nothing at the top says what the module is for."),
                   "Open the module with a docstring."),
        ),
        F.when(
            checked & name.rlike(r"^[a-z]{1,2}\z"),
            _issue("short-function-name", "bad_naming", "low", 0.65,
                   _named("Function name '", "' is very short"),
                   F.lit("One or two letters say little about the purpose."),
                   "Choose a name that says what the function does.", whole=True),
        ),
        F.when(
            checked & (length > MAX_FUNCTION_LINES),
            _issue("long-function", "long_method", "medium", 0.9,
                   _named("Function '", "' is too long"),
                   F.concat(F.lit("It runs over "), length,
                            F.lit(f" lines, more than {MAX_FUNCTION_LINES}.")),
                   "Divide it into smaller functions.", whole=True),
        ),
        F.when(
            is_function & ~name.startswith("_") & ~F.col("has_docstring"),
            _issue("missing-function-docstring", "missing_documentation", "low", 0.75,
                   _named("Function '", "' has no docstring"),
                   F.lit("Callers are not told what it does and takes."),
                   "Write a docstring."),
        ),
        F.when(
            checked & (F.col("complexity") > MAX_COMPLEXITY),
            _issue("high-cyclomatic-complexity", "complexity", "medium", 0.85,
                   _named("Function '", "' branches a lot"),
                   F.concat(F.lit("Its cyclomatic complexity is about "), F.col("complexity"),
                            F.lit(f", more than {MAX_COMPLEXITY}.")),
                   "Untangle the branches or divide the function.", whole=True),
        ),
        F.when(
            (kind == "class") & ~F.col("has_docstring"),
            _issue("missing-class-docstring", "missing_documentation", "low", 0.7,
                   _named("Class '", "' has no docstring"),
                   F.lit("Readers are not told what it is responsible for."),
                   "Write a docstring."),
        ),
        F.when(
            (kind == "call") & name.isin("eval", "exec"),
            _issue("python-eval-exec", "security", "critical", 0.95,
                   _named("", "() call"), _named("", "() runs any code it is given."),
                   "Do without running text as code."),
        ),
        F.when(
            (kind == "call") & name.isin("subprocess.run", "subprocess.call") & F.col("shell_true"),
            _issue("subprocess-shell-true", "security", "high", 0.9,
                   F.lit("subprocess with shell=True"),
                   F.lit("Arguments may smuggle in shell commands."),
                   "Pass a list of arguments and no shell."),
        ),
    )
    # Imports less names in use, per module: a set difference inside the row.
    unused = F.array_except(
        F.array_except(F.col("imported"), F.col("used")), F.array(F.lit("__future__"))
    )
    unused_issues = F.transform(
        F.coalesce(unused, F.array().cast("array<string>")),
        lambda n: _issue(
            "unused-import", "unused_import", "low", 0.6,
            F.concat(F.lit("Import '"), n, F.lit("' seems unused")),
            F.concat(F.lit("No identifier in the module is '"), n, F.lit("'.")),
            "Delete the import.",
        ),
    )
    return facts.select(
        "review_id", "file_path", F.explode_outer(F.concat(F.array_compact(rules), unused_issues)).alias("_i")
    ).where(F.col("_i").isNotNull()).select("review_id", "file_path", "_i.*").select(*ISSUE_COLUMNS)


def parser_failures(facts: DataFrame) -> DataFrame:
    """Reviews to be marked failed because a file broke the parser itself."""
    broken = facts.where(F.col("kind") == "parser_failure")
    return broken.groupBy("review_id").agg(
        F.min("file_path").alias("file_path"), F.count("*").alias("n_files")
    )
