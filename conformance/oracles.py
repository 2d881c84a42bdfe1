"""SQL that states what each registered query must return.

Where a view was rendered from columns, the answer is derived from those columns
and never from the rendered text.
"""

from __future__ import annotations

from conformance import views as V
from lintmill.operators import ai_prepare

ORACLES: dict[str, str] = {}

# ---- fixed values, stated here anew: an oracle must not take them from what it checks ----

CATEGORIES = [
    "bug",
    "duplicated_code",
    "long_method",
    "bad_naming",
    "security",
    "code_smell",
    "dead_code",
    "complexity",
    "missing_documentation",
    "unused_import",
]
SEVERITY_PENALTY = {"critical": 15.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.5}
SEVERITIES = list(SEVERITY_PENALTY)
# Category, severity and confidence of each line rule.
RULES = {
    "long-line": ("code_smell", "low", 0.9),
    "todo-comment": ("code_smell", "info", 0.95),
    "hardcoded-api-key": ("security", "high", 0.85),
    "aws-access-key": ("security", "critical", 0.85),
    "js-eval": ("security", "critical", 0.95),
    "js-inner-html": ("security", "high", 0.85),
    "js-document-write": ("security", "medium", 0.8),
    "js-console-log": ("code_smell", "info", 0.7),
    "js-var-keyword": ("code_smell", "low", 0.75),
    "js-any-type": ("code_smell", "low", 0.8),
    "js-empty-catch": ("bug", "medium", 0.85),
    "java-system-out": ("code_smell", "low", 0.85),
    "java-empty-catch": ("bug", "medium", 0.85),
    "java-thread-stop": ("bug", "high", 0.7),
    "go-fmt-println": ("code_smell", "info", 0.7),
    "go-panic": ("bug", "medium", 0.75),
    "go-empty-err-check": ("code_smell", "low", 0.65),
    "rust-unwrap": ("bug", "medium", 0.8),
    "rust-expect": ("code_smell", "low", 0.7),
    "rust-unsafe": ("security", "high", 0.9),
    "csharp-empty-catch": ("bug", "medium", 0.85),
    "csharp-console-write": ("code_smell", "info", 0.75),
    "cpp-using-namespace-std": ("code_smell", "low", 0.9),
    "cpp-malloc-free": ("code_smell", "medium", 0.85),
    "cpp-strcpy": ("security", "high", 0.9),
}
DEFAULT_SETTINGS = {
    "ollama_base_url": "http://localhost:11434",
    "ollama_model": "qwen2.5",
    "ollama_timeout_seconds": 120,
    "ai_max_files": 10,
    "ai_max_chars_per_file": 4000,
    "ai_temperature": 0.2,
    "max_file_size_bytes": 1048576,
    "ignored_folders": "node_modules,.git,__pycache__,dist,build,.venv,venv",
    "ignored_extensions": ".min.js,.map,.lock,.png,.jpg,.jpeg,.gif,.svg,.ico,.woff,.woff2",
}
MAX_CHARS = 4000


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- scan and filters -------------------------------------------------------

_LANGUAGE = """case when doc_id % 19 = 0 then 'unknown' else case doc_id % 17
    when 0 then 'python' when 1 then 'javascript' when 2 then 'javascript' when 3 then 'typescript'
    when 4 then 'typescript' when 5 then 'java' when 6 then 'go' when 7 then 'rust' when 8 then 'csharp'
    when 9 then 'cpp' when 10 then 'cpp' when 11 then 'python' when 12 then 'javascript'
    else 'unknown' end end"""
_FOLDER_KEPT = "doc_id % 9 in (0, 4, 5, 7)"
# Of the default extensions only .map and .lock occur as a last suffix.
_EXT_KEPT = "(doc_id % 19 = 0 or doc_id % 17 not in (13, 16))"
_DEFAULT_KEPT = f"{_FOLDER_KEPT} and {_LANGUAGE} <> 'unknown' and n_chars <= 1048576"

ORACLES["scan_order"] = f"""
    with p as (
      select doc_id, source as review_id, {_LANGUAGE} as language,
        {_list(V.FOLDERS)}[doc_id % 9 + 1] || '/f' || doc_id || {_list(V.EXTENSIONS)}[doc_id % 17 + 1] as file_path
      from documents where {_DEFAULT_KEPT})
    select doc_id, review_id, file_path, language,
      row_number() over (partition by review_id order by string_split(file_path, '/')) as position
    from p"""
ORACLES["corpus_scan"] = f"""
    with t as (select *, case when doc_id % 16 = 5 then repeat(text, 1100000 // length(text) + 1) else text end as x from documents)
    select doc_id, source as review_id, {_LANGUAGE} as language,
      'd' || doc_id || '/' || {_list(V.FOLDERS)}[doc_id % 9 + 1] || '/f' || doc_id || {_list(V.EXTENSIONS)}[doc_id % 17 + 1] as file_path,
      octet_length(encode(x)) as size_bytes,
      sha256(regexp_replace(x, '\\r\\n?', chr(10), 'g')) as digest
    from t where {_FOLDER_KEPT} and {_LANGUAGE} <> 'unknown' and octet_length(encode(x)) <= 1048576"""
ORACLES["detect_language"] = f"select doc_id, {_LANGUAGE} as language from documents"
ORACLES["filter_ignored_folders"] = f"select doc_id from documents where {_FOLDER_KEPT}"
ORACLES["filter_ignored_ext"] = f"select doc_id from documents where {_EXT_KEPT}"

# A document's user is doc_id % 100, whose settings depend on that number % 6.
_USER = "(doc_id % 100)"
_MAX_SIZE = f"case {_USER} % 6 when 3 then 2000 when 5 then 4096 else 1048576 end"
_USER_EXISTS = f"{_USER} in (select c_custkey from customer)"
# A user without a row has the defaults.
_KIND = f"(case when {_USER_EXISTS} then {_USER} % 6 else 0 end)"
_MAX_OR_DEFAULT = f"case {_KIND} when 3 then 2000 when 5 then 4096 else 1048576 end"
ORACLES["filter_size"] = f"select doc_id from documents where {_USER_EXISTS} and n_chars <= {_MAX_SIZE}"
ORACLES["analyzable_files"] = f"""
    select doc_id, 'u' || {_USER} as user_id, {_LANGUAGE} as language from documents
    where n_chars <= {_MAX_OR_DEFAULT} and {_LANGUAGE} <> 'unknown'
      and case {_KIND}
        when 2 then doc_id % 9 not in (0, 6, 7)   -- src, src/build/x, a/b/c
        when 5 then doc_id % 9 <> 4               -- lib/venv2
        else {_FOLDER_KEPT} end
      and case {_KIND}
        when 3 then doc_id % 17 not in (0, 3, 11) -- .py, .ts, .PY
        when 5 then doc_id % 17 <> 6              -- .go
        else true end
      and ({_KIND} <> 5 or doc_id % 9 not in (4, 1) or doc_id % 9 = 1 and false)"""

_OWN = "c_custkey % 6"
_D = DEFAULT_SETTINGS
ORACLES["settings_lists"] = f"""
    select 'u' || c_custkey as user_id,
      case {_OWN} when 2 then 'src|a' when 5 then 'lib' else '{_D["ignored_folders"].replace(",", "|")}' end as folders,
      case {_OWN} when 3 then '.PY|.ts' when 5 then '.go'
        else '{_D["ignored_extensions"].replace(",", "|")}' end as extensions
    from customer"""
ORACLES["effective_settings"] = f"""
    select 'u' || c_custkey as user_id,
      case {_OWN} when 5 then 'http://h5' else '{_D["ollama_base_url"]}' end as ollama_base_url,
      case {_OWN} when 1 then 'm1' when 5 then 'model5' else '{_D["ollama_model"]}' end as ollama_model,
      120 as ollama_timeout_seconds, 10 as ai_max_files, 4000 as ai_max_chars_per_file,
      cast(0.2 as double) as ai_temperature,
      case {_OWN} when 3 then 2000 when 5 then 4096 else 1048576 end as max_file_size_bytes,
      case {_OWN} when 2 then 'src, a' when 5 then 'lib' else '{_D["ignored_folders"]}' end as ignored_folders,
      case {_OWN} when 3 then ' .PY,.ts , ,' when 5 then '.go' else '{_D["ignored_extensions"]}' end as ignored_extensions
    from customer"""
ORACLES["patch_settings"] = f"""
    with {V.oracle_ctes("settings_v")},
    b as (select c_custkey % 7 as p, 'u' || c_custkey as user_id, s.* exclude (user_id)
          from customer left join settings_v s on s.user_id = 'u' || c_custkey
          where c_custkey % 6 <> 0 or c_custkey % 7 <> 0)
    select user_id,
      case when p = 3 then null else ollama_base_url end as ollama_base_url,
      case when p = 1 then null when p = 2 then 'p1' else ollama_model end as ollama_model,
      case when p = 2 then 'x' else ignored_folders end as ignored_folders,
      case when p = 3 then '.q' when p = 6 then null else ignored_extensions end as ignored_extensions,
      case when p = 2 then 5000 when p = 5 then 7777 else max_file_size_bytes end as max_file_size_bytes
    from b"""
ORACLES["validate_settings"] = """
    select 'u' || c_custkey as user_id,
      case when c_custkey % 9 = 3 then 'url_too_long' when c_custkey % 9 = 5 then 'model_too_long'
        when c_custkey % 4 in (0, 2) then 'size_out_of_range' when c_custkey % 9 = 0 then 'url_scheme'
        else 'accepted' end as outcome
    from customer"""

# ---- texts ------------------------------------------------------------------

# Carriage returns alone are line ends too; FFFD stands for the byte C3.
ORACLES["decode_text"] = r"""
    with t as (select doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(65533) || '(',
      '\r\n?', chr(10), 'g') as t from documents)
    select doc_id, length(t) as n_chars, sha256(t) as digest from t"""

_BLANKS = "||".join(
    f"chr({c})"
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
_DOC_LINES = r"""
    split as (
      select source as review_id, 'src/' || lang || '/' || doc_id || '.js' as file_path,
        string_split_regex(text, '\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') as parts from documents),
    doc_lines as (
      select review_id, file_path,
        case when parts[-1] = '' then parts[:-2] else parts end as lines from split)"""
_NUMBERED = """
    numbered as (
      select review_id, file_path, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as line_no
      from doc_lines)"""
_SKIPPED = f"(trim(line, {_BLANKS}) = '' or starts_with(trim(line, {_BLANKS}), '#'))"

ORACLES["lines"] = f"""
    with {_DOC_LINES}, {_NUMBERED}
    select file_path, line_no, length(line) as n_chars, md5(line) as digest from numbered"""


def _meta(rule_id: str) -> str:
    category, severity, confidence = RULES[rule_id]
    return f"'{category}' as category, '{severity}' as severity, cast({confidence} as double) as confidence, '{rule_id}' as rule_id"


_SECRET = r"""(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[''"][^''"]{8,}[''"]"""
ORACLES["rule_long_line"] = f"""
    with {_DOC_LINES}, {_NUMBERED}
    select review_id, file_path, line_no as line_start, line_no as line_end, {_meta("long-line")}
    from numbered where length(line) > 120 and not {_SKIPPED}"""
ORACLES["rule_secret"] = f"""
    with {_DOC_LINES}, {_NUMBERED}
    select review_id, file_path, line_no as line_start, line_no as line_end, {_meta("hardcoded-api-key")}
    from numbered where regexp_matches(line, '{_SECRET}') and not {_SKIPPED}"""

# The hits of code files follow from the template numbers alone.
_CODE_TEMPLATES = ", ".join(
    f"({n}, {len(V.templates_of(name))})" for n, name in enumerate(V.CODE_LANGUAGES)
)
_CODE_HITS = ", ".join(
    f"({n}, {t}, '{rule}', '{RULES[rule][0]}', '{RULES[rule][1]}', {RULES[rule][2]})"
    for n, name in enumerate(V.CODE_LANGUAGES)
    for t, (_, rules) in enumerate(V.templates_of(name))
    for rule in rules
)
_ENDINGS = _list([V.LANGUAGE_TEMPLATES[name][0] for name in V.CODE_LANGUAGES])
_CODE_ISSUES = f"""
    sizes(lang, n_templates) as (values {_CODE_TEMPLATES}),
    hits(lang, template, rule_id, category, severity, confidence) as (values {_CODE_HITS}),
    code_lines as (
      select o_custkey, o_orderkey, o_orderkey % 7 as lang, unnest(range(1, 4 + o_orderkey % 13)) as line_no
      from orders),
    code_issues as (
      select 'c' || o_custkey as review_id, 'src/' || o_orderkey || {_ENDINGS}[lang + 1] as file_path,
        line_no as line_start, line_no as line_end, category, severity,
        cast(confidence as double) as confidence, rule_id
      from code_lines join sizes using (lang)
      join hits on hits.lang = code_lines.lang and template = (o_orderkey // 7 + line_no) % n_templates)"""


def _code_oracle(where: str) -> str:
    return f"with {_CODE_ISSUES} select * from code_issues where {where}"


ORACLES["rule_todo"] = _code_oracle("rule_id = 'todo-comment'")
ORACLES["rule_aws_key"] = _code_oracle("rule_id = 'aws-access-key'")
ORACLES["common_rules"] = _code_oracle(
    "rule_id in ('long-line', 'todo-comment', 'hardcoded-api-key', 'aws-access-key')"
)
for _prefix in ("js", "java", "go", "rust", "csharp", "cpp"):
    ORACLES[f"rules_{_prefix}"] = _code_oracle(f"rule_id like '{_prefix}-%'")

# RE2 knows ASCII word boundaries only, hence explicit classes.
_NOT_WORD = r"(^|[^\pL\pN_])"
_SCRIPT_PATTERNS = {
    "js-eval": _NOT_WORD + r"eval\s*\(",
    "js-inner-html": r"\.innerHTML\s*=",
    "js-document-write": _NOT_WORD + r"document\.write\s*\(",
    "js-console-log": _NOT_WORD + r"console\.(log|debug|info)\s*\(",
    "js-var-keyword": _NOT_WORD + r"var\s+[\pL\pN_]",
    "js-any-type": r":\s*any([^\pL\pN_]|$)",
    "js-empty-catch": r"catch\s*\([^)]*\)\s*\{\s*\}",
}


def _script_hits(source: str) -> str:
    return " union all ".join(
        f"select review_id, file_path, line_no as line_start, line_no as line_end, {_meta(rule)} "
        f"from {source} where regexp_matches(line, '{pattern}')"
        for rule, pattern in _SCRIPT_PATTERNS.items()
    )


_PAGE_LINES = _DOC_LINES.replace(
    "source as review_id, 'src/' || lang || '/' || doc_id || '.js' as file_path",
    "'pages' as review_id, 'pages/' || page_id || '.js' as file_path",
).replace("string_split_regex(text,", "string_split_regex(html,").replace("from documents", "from pages")
ORACLES["rules_js_pages"] = f"with {_PAGE_LINES}, {_NUMBERED} {_script_hits('numbered')}"

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
ORACLES["rule_large_file"] = f"""
    select 'u' || user_id as review_id, 'm/' || event_id || '.go' as file_path, 1 as line_start,
      {_K} * 10 + event_id % 2 as line_end, 'complexity' as category, 'medium' as severity,
      cast(0.8 as double) as confidence, 'large-file' as rule_id
    from events where {_K} * 10 + event_id % 2 > 500"""

# ---- spans and Python -------------------------------------------------------

ORACLES["long_functions_js"] = f"""
    with e as (select *, {_K} as k, cast(floor(value) as int) % 70 as j, event_id % 3 + 1 as s from events),
    f as (
      select user_id, event_id, s as line_start,
        case when event_id % 17 = 0 then s + k + j + 4 else s + k + j + 3 end as line_end,
        case when event_id % 5 = 0 then 'g' else 'f' end as name from e
      union all
      select user_id, event_id, s + k + 1, s + k + j + 2, 'if' from e)
    select 'u' || user_id as review_id, 'm/' || event_id || '.ts' as file_path, line_start, line_end, name
    from f where line_end - line_start + 1 > 50"""

# Lines before the function: 6.  Its body: doc, k lines, b branches of two lines, maybe
# a boolean line, one line by type, return.
_PY = f"""
    p as (
      select 'u' || user_id as review_id, 'm/' || event_id || '.py' as file_path, *, {_K} as k,
        cast(floor(value) as int) % 15 as b, case when event_id % 4 = 0 then 1 else 0 end as bool_line,
        case event_id % 13 when 0 then 'fn' when 1 then '_hidden' when 2 then '__dunder__'
          else 'work_item' end as name from events),
    py as (select *, 7 as def_line, 7 + 1 + k + 2 * b + bool_line + 2 as end_line, 1 + b + 2 * bool_line as complexity from p)"""


def _py_oracle(rule: str, category: str, severity: str, confidence: float, start: str, end: str, where: str) -> str:
    return f"""
        select review_id, file_path, {start} as line_start, {end} as line_end, '{category}' as category,
          '{severity}' as severity, cast({confidence} as double) as confidence, '{rule}' as rule_id
        from py where {where}"""


_PY_RULES = {
    "py_module_doc": ("missing-module-docstring", "missing_documentation", "low", 0.7, "1", "1", "event_id % 3 <> 0"),
    "py_short_name": ("short-function-name", "bad_naming", "low", 0.65, "def_line", "end_line", "name = 'fn'"),
    "py_long_function": ("long-function", "long_method", "medium", 0.9, "def_line", "end_line",
                         "end_line - def_line + 1 > 50 and name <> '_hidden'"),
    "py_function_doc": ("missing-function-docstring", "missing_documentation", "low", 0.75, "def_line", "def_line",
                        "event_type <> 'view' and name in ('fn', 'work_item')"),
    "py_complexity": ("high-cyclomatic-complexity", "complexity", "medium", 0.85, "def_line", "end_line",
                      "complexity > 10 and name <> '_hidden'"),
    "py_class_doc": ("missing-class-docstring", "missing_documentation", "low", 0.7, "5", "5", "event_id % 5 <> 0"),
    "py_eval": ("python-eval-exec", "security", "critical", 0.95, "end_line - 1", "end_line - 1", "event_type = 'error'"),
    "py_shell_true": ("subprocess-shell-true", "security", "high", 0.9, "end_line - 1", "end_line - 1",
                      "event_type = 'purchase'"),
}
for _key, _spec in _PY_RULES.items():
    ORACLES[_key] = f"with {_PY} {_py_oracle(*_spec)}"
ORACLES["py_unused_import"] = f"""
    with {_PY} select review_id, file_path, 1 as line_start,
      case when event_id % 2 = 0 then 'b2' else 'mod_a' end as name from py"""
_SYNTAX = ("python-syntax-error", "bug", "high", 0.99, "end_line + 1", "end_line + 1", "user_id % 11 = 0")
ORACLES["py_syntax_error"] = f"with {_PY} {_py_oracle(*_SYNTAX)}"
_PARSED = [(*spec[:6], spec[6] + " and user_id % 11 <> 0") for spec in _PY_RULES.values()]
_PARSED.append(("unused-import", "unused_import", "low", 0.6, "1", "1", "user_id % 11 <> 0"))
ORACLES["py_all_rules"] = f"""
    with {_PY}, found as ({" union all ".join(_py_oracle(*s) for s in [*_PARSED, _SYNTAX])})
    select file_path, rule_id, count(*) as n from found group by all"""

# ---- duplicates and scores --------------------------------------------------

_BLOCKS = f"""
    stripped as (
      select review_id, file_path, list_transform(lines, lambda x: trim(x, {_BLANKS})) as lines from doc_lines
      where len(lines) >= 4),
    windows as (select review_id, file_path, lines, unnest(range(1, len(lines) - 2)) as line_start from stripped),
    blocks as (
      select review_id, file_path, line_start, lines[line_start:line_start + 3] as block from windows),
    shingled as (
      select review_id, file_path, line_start, sha256(array_to_string(block, chr(10))) as digest from blocks
      where len(list_filter(block, lambda x: x <> '' and not starts_with(x, '//') and not starts_with(x, '#'))) > 0)"""
_GROUPED = """
    grouped as (
      select {review} as review_id, digest,
        list_sort(list({{'p': string_split(file_path, '/'), 's': line_start, 'f': file_path}})) as places
      from shingled group by all having count(*) >= 2)"""
ORACLES["shingles"] = f"with {_DOC_LINES}, {_BLOCKS} select * from shingled"
for _key, _review in [("dup_blocks", "review_id"), ("dup_blocks_one_review", "'all'")]:
    ORACLES[_key] = f"""
        with {_DOC_LINES}, {_BLOCKS}, {_GROUPED.format(review=_review)}
        select review_id, places[1].f as file_path, places[1].s as line_start, places[1].s + 3 as line_end,
          places[2].f as other_path, places[2].s as other_line from grouped"""

# No document holds a brace function or more than 500 lines; the empty parts say so.
_DOC_ISSUES = f"""
    {_DOC_LINES}, {_NUMBERED}, {_BLOCKS}, {_GROUPED.format(review="review_id")},
    counted_lines as (select *, {_SKIPPED} as skipped from numbered),
    issues as (
      select review_id, file_path, 'long-line' as rule_id, 'low' as severity from counted_lines
        where not skipped and length(line) > 120
      union all select review_id, file_path, 'todo-comment', 'info' from counted_lines
        where not skipped and regexp_matches(line, '{_NOT_WORD}(TODO|FIXME|HACK|XXX)([^\\pL\\pN_]|$)')
      union all select review_id, file_path, 'hardcoded-api-key', 'high' from counted_lines
        where not skipped and regexp_matches(line, '{_SECRET}')
      union all select review_id, file_path, 'aws-access-key', 'critical' from counted_lines
        where not skipped and regexp_matches(line, 'AKIA[0-9A-Z]{{16}}')
      union all select review_id, file_path, rule_id, severity from ({_script_hits("numbered")})
      union all select review_id, file_path, 'large-file', 'medium' from doc_lines where len(lines) > 500
      union all select review_id, places[1].f, 'duplicated-block', 'medium' from grouped)"""
_PENALTY = "case severity " + " ".join(f"when '{s}' then {p}" for s, p in SEVERITY_PENALTY.items()) + " else 1.0 end"
_DOC_RESULTS = f"""
    {_DOC_ISSUES},
    totals as (select file_path, count(*) as n, sum(cast({_PENALTY} as decimal(18, 1))) as penalty from issues group by file_path),
    results as (
      select review_id, file_path, 'javascript' as language, len(lines) as line_count,
        coalesce(n, 0) as issues_count,
        cast(greatest(0, 100 - coalesce(penalty, 0)) as double) as file_score
      from doc_lines left join totals using (file_path))"""
ORACLES["all_issues"] = f"""
    with {_DOC_ISSUES} select review_id, rule_id, severity, count(*) as n from issues group by all"""
ORACLES["file_results"] = f"with {_DOC_RESULTS} select * from results"
ORACLES["file_scores"] = f"with {_DOC_RESULTS} select review_id, file_path, file_score from results"
# printf rounds a double correctly, as Python's round does.
_DOC_SCORES = f"""
    {_DOC_RESULTS},
    ids as (select distinct p || source as review_id, source from documents, (values (''), ('empty-')) v(p)),
    per_review as (
      select review_id, count(*) as files, sum(issues_count) as issues,
        cast(printf('%.2f', sum(file_score) / count(*)) as double) as score from results group by review_id),
    scores as (
      select review_id, source, coalesce(files, 0) as files_analyzed,
        cast(coalesce(issues, 0) as bigint) as issues_in_files, coalesce(score, 100.0) as overall_score
      from ids left join per_review using (review_id))"""
ORACLES["review_scores"] = f"with {_DOC_SCORES} select * exclude (source) from scores"
ORACLES["review_summary"] = f"""
    with {_DOC_SCORES}
    select review_id, files_analyzed, issues_in_files as issues_count, overall_score,
      'Analyzed ' || files_analyzed || ' files in own/' || source || '. Found ' || issues_in_files
        || ' issues with an overall score of ' || overall_score || '.' as summary
    from scores"""

# The same over files of all kinds. Lines are lists here, made from the columns.
_TEMPLATE_LISTS = "[" + ", ".join(_list([t for t, _ in V.templates_of(name)]) for name in V.CODE_LANGUAGES) + "]"


def _times(line: str, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda _: '{line}')"


_MIXED_ISSUES = f"""
    {_DOC_LINES.replace("doc_lines as", "text_lines as")},
    {_NUMBERED.replace("doc_lines", "text_lines")}, {_CODE_ISSUES}, {_PY},
    counted_lines as (select *, {_SKIPPED} as skipped from numbered),
    code_texts as (
      select 'c' || o_custkey as review_id, 'src/' || o_orderkey || {_ENDINGS}[lang + 1] as file_path, {_list(V.CODE_LANGUAGES)}[lang + 1] as language,
        list_transform(range(1, 4 + o_orderkey % 13),
          lambda i: templates[lang + 1][(o_orderkey // 7 + i) % len(templates[lang + 1]) + 1]) as lines
      from (select *, o_orderkey % 7 as lang, {_TEMPLATE_LISTS} as templates from orders)),
    e as (select *, 'u' || user_id as review_id, {_K} as k, cast(floor(value) as int) as v from events),
    doc_lines as (
      select review_id, file_path, 'javascript' as language, lines from text_lines
      union all select review_id, file_path, language, case when lines[-1] = '' then lines[:-2] else lines end from code_texts
      union all select review_id, 'm/' || event_id || '.go', 'go', {_times("x", "k * 10 + event_id % 2")} from e
      union all select review_id, 'm/' || event_id || '.ts', 'typescript',
        {_times("x;", "event_id % 3")} || [case when event_id % 5 = 0 then 'const g = async (a) => {{' else 'function f(a) {{' end]
        || {_times("  a += 1;", "k")} || ['  if (a) {{'] || {_times("    a += 2;", "v % 70")} || ['  }}']
        || case when event_id % 17 = 0 then [] else ['}}'] end || ['x;', 'x;'] from e
      union all select review_id, 'm/' || event_id || '.py', 'python',
        [case when event_id % 3 = 0 then '\"\"\"Module.\"\"\"' else 'x = 0' end, 'import mod_a', 'from pkg import long_name as b2',
          case when event_id % 2 = 0 then 'print(mod_a)' else 'print(b2)' end, 'class Box:',
          case when event_id % 5 = 0 then '    "Doc."' else '    pass' end,
          'def ' || case event_id % 13 when 0 then 'fn' when 1 then '_hidden' when 2 then '__dunder__' else 'work_item' end || '(a):',
          case when event_type = 'view' then '    "Doc."' else '    a = 1' end]
        || {_times("    a += 1", "k")} || list_transform(range(0, 2 * (v % 15)), lambda i: case when i % 2 = 0 then '    if a:' else '        a = 2' end)
        || case when event_id % 4 = 0 then ['    c = a and b or a'] else [] end
        || [case event_type when 'error' then '    eval("1")' when 'purchase' then '    subprocess.run("x", shell=True)'
          when 'click' then '    subprocess.Popen("x", shell=True)' when 'signup' then '    subprocess.call("x", shell=False)' else '    pass' end, '    return a']
        || case when user_id % 11 = 0 then ['def broken(:'] else [] end from e),
    {_BLOCKS}, {_GROUPED.format(review="review_id")},
    issues as (
      select review_id, file_path, 'long-line' as rule_id, 'low' as severity, line_no as line_start from counted_lines
        where not skipped and length(line) > 120
      union all select review_id, file_path, 'todo-comment', 'info', line_no from counted_lines
        where not skipped and regexp_matches(line, '{_NOT_WORD}(TODO|FIXME|HACK|XXX)([^\\pL\\pN_]|$)')
      union all select review_id, file_path, 'hardcoded-api-key', 'high', line_no from counted_lines
        where not skipped and regexp_matches(line, '{_SECRET}')
      union all select review_id, file_path, 'aws-access-key', 'critical', line_no from counted_lines
        where not skipped and regexp_matches(line, 'AKIA[0-9A-Z]{{16}}')
      union all select review_id, file_path, rule_id, severity, line_start from ({_script_hits("numbered")})
      union all select review_id, file_path, rule_id, severity, line_start from code_issues
      union all select review_id, file_path, rule_id, severity, line_start
        from ({" union all ".join(_py_oracle(*s) for s in [*_PARSED, _SYNTAX])})
      union all select review_id, file_path, 'long-function-heuristic', 'medium', line_start from ({ORACLES["long_functions_js"]})
      union all select review_id, file_path, 'large-file', 'medium', 1 from doc_lines where len(lines) > 500
      union all select review_id, places[1].f, 'duplicated-block', 'medium', places[1].s from grouped)"""
ORACLES["static_review_issues"] = f"""
    with {_MIXED_ISSUES}
    select review_id, file_path, rule_id, severity, count(*) as n, cast(sum(line_start) as bigint) as lines from issues group by all"""
_MIXED_RESULTS = f"""
    {_MIXED_ISSUES},
    totals as (
      select review_id, file_path, count(*) as n, sum(cast({_PENALTY} as decimal(18, 1))) as penalty from issues group by all),
    results as (
      select review_id, file_path, language, len(lines) as line_count, coalesce(n, 0) as issues_count,
        cast(greatest(0, 100 - coalesce(penalty, 0)) as double) as file_score
      from doc_lines left join totals using (review_id, file_path))"""
ORACLES["static_review_files"] = f"with {_MIXED_RESULTS} select * from results"
ORACLES["static_review_summary"] = f"""
    with {_MIXED_RESULTS},
    ids as (
      select distinct p || id as review_id, id from (
        select source as id from documents union select 'c' || o_custkey from orders union select 'u' || user_id from events),
        (values (''), ('empty-')) v(p)),
    per_review as (
      select review_id, count(*) as files, sum(issues_count) as n,
        cast(printf('%.2f', sum(file_score) / count(*)) as double) as score from results group by review_id),
    scores as (
      select review_id, id, coalesce(files, 0) as files_analyzed, cast(coalesce(n, 0) as bigint) as issues_count,
        coalesce(score, 100.0) as overall_score from ids left join per_review using (review_id))
    select review_id, 'completed' as status, files_analyzed, issues_count, overall_score,
      'Analyzed ' || files_analyzed || ' files in own/' || id || '. Found ' || issues_count
        || ' issues with an overall score of ' || overall_score || '.' as summary
    from scores"""

_SEVERITY_RANK = "case severity " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEVERITIES)) + " end"
ORACLES["severity_counts"] = f"""
    with {V.oracle_ctes("issues_v")}
    select review_id, severity, count(*) as n_issues, {_SEVERITY_RANK} as severity_rank from issues_v group by all"""

# ---- catalogue --------------------------------------------------------------

_REVIEWS, _REPOS, _ISSUES = V.oracle_ctes("reviews_v"), V.oracle_ctes("repos_v"), V.oracle_ctes("issues_v")
ORACLES["review_by_id"] = f"""
    with {_REVIEWS}
    select id as review_id, user_id, status, issues_count as issues_loaded,
      (select count(distinct l_partkey) from lineitem where l_orderkey = cast(reviews_v.id as bigint)) as files_loaded
    from reviews_v"""
ORACLES["ready_gate"] = """
    select o_orderkey as request,
      case when o_orderkey % 5 = 0 or o_orderkey % 3 = 0 then 'not_found'
        when c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey % 10 <> 0 then 'ready'
        else 'not_ready' end as outcome
    from orders join customer on c_custkey = o_custkey"""
ORACLES["list_reviews"] = f"""
    with {_REVIEWS}
    select user_id, repository_id, id,
      row_number() over (partition by user_id, repository_id order by created_at desc, id) as position from reviews_v"""
ORACLES["list_repositories"] = f"""
    with {_REPOS}
    select user_id, id, status, row_number() over (partition by user_id order by created_at desc, id) as position,
      count(*) over (partition by user_id) as total from repos_v"""
for _key, _type in [("latest_review", "true"), ("latest_review_by_type", "n.review_type = r.review_type")]:
    _columns = "id, status, issues_count" if _key == "latest_review" else "review_type, id"
    ORACLES[_key] = f"""
        with {_REVIEWS}
        select repository_id, user_id, {_columns} from reviews_v r
        where not exists (select 1 from reviews_v n where n.repository_id = r.repository_id and n.user_id = r.user_id
          and {_type} and (n.created_at > r.created_at or n.created_at = r.created_at and n.id < r.id))"""
ORACLES["dashboard"] = f"""
    with {_REVIEWS}, {_REPOS},
    newest as (select repository_id, user_id, arg_min(issues_count, row(-epoch(created_at), id)) as n
      from reviews_v group by all)
    select p.user_id, count(*) as repositories_added, count(*) filter (p.status = 'ready') as repositories_ready,
      cast(coalesce(sum(n) filter (p.status = 'ready'), 0) as bigint) as total_issues
    from repos_v p left join newest w on w.repository_id = p.id and w.user_id = p.user_id group by p.user_id"""

_FOUND = f"with {_REVIEWS}, {_REPOS}, {_ISSUES}, r as (select v.*, owner, name from reviews_v v join repos_v p on p.id = v.repository_id)"
ORACLES["search_reviews"] = f"""{_FOUND}
    select user_id, id, repository_id, owner || '/' || name as repository_name, review_type, status, overall_score,
      issues_count, files_analyzed, summary, ai_model, strftime(created_at, '%Y-%m-%d') as created_at from r"""
_HAS = "exists (select 1 from issues_v i where i.review_id = r.id and {0})"


def _like(pattern: str) -> str:
    parent = " or ".join(f"{c} ilike '{pattern}'" for c in ("summary", "report_markdown", "owner", "name"))
    child = " or ".join(f"i.{c} ilike '{pattern}'" for c in ("title", "explanation", "file_path"))
    return f"({parent} or {_HAS.format(f'({child})')})"


for _key, _where in {
    "search_filters": "review_type = 'static' and status = 'completed'",
    "search_score_range": "overall_score between 20 and 60",
    "search_date_range": "created_at >= timestamp '1996-01-01' and created_at <= timestamp '1997-06-30'",
    "search_by_severity": _HAS.format("i.severity = 'critical'"),
    "search_text": _like("%TITLE 7%"),
    "search_text_wildcard": _like("%order_%9%"),
    "search_text_index": _like("%TITLE 7%"),
    "search_wildcard_index": _like("%order_%9%"),
    "search_index_filters": f"status = 'completed' and overall_score >= 20 and {_like('%explains 1%')}",
}.items():
    ORACLES[_key] = f"{_FOUND} select user_id, id from r where {_where}"
ORACLES["search_total"] = f"""{_FOUND}
    select user_id, count(*) as total from r
    where overall_score >= 50 and {_HAS.format("i.severity = 'high'")} group by user_id"""
for _key, _order in {
    "search_sort_score": "overall_score",
    "search_sort_score_down": "overall_score desc",
    "search_sort_issues": "issues_count desc",
    "search_sort_issues_up": "issues_count",
    "search_sort_created": "created_at desc",
    "search_sort_created_up": "created_at",
}.items():
    ORACLES[_key] = f"""{_FOUND}
        select user_id, id, row_number() over (partition by user_id order by {_order}, id) as position from r"""
ORACLES["search_page"] = f"""{_FOUND},
    u as (select distinct user_id from r)
    select u.user_id, x.position + 5 as position, x.id, x.repository_name, x.overall_score
    from u, lateral (
      select row_number() over (order by overall_score desc, id) as position, * from (
        select id, owner || '/' || name as repository_name, overall_score from r
        where r.user_id = u.user_id and status = 'completed' order by overall_score desc, id limit 10 offset 5)) x"""

# ---- language-model reviews -------------------------------------------------

_TOP = """
    top as (
      select *, (select count(*) from doc_lines e where e.review_id = d.review_id
        and string_split(e.file_path, '/') <= string_split(d.file_path, '/')) as file_rank
      from doc_lines d)"""
ORACLES["ai_top_files"] = f"""
    with {_DOC_LINES}, {_TOP} select review_id, file_path, file_rank from top where file_rank <= 10"""
ORACLES["ai_prepared_files"] = f"""
    with {_DOC_LINES}, {_TOP}
    select review_id, file_path, 'javascript' as language, len(lines) as line_count from top where file_rank <= 10"""
ORACLES["ai_without_files"] = """
    select distinct 'empty-' || source as review_id, 'failed' as status, 'There are no source files to review' as error_message
    from documents"""
# The budget, spelled out: walk the lines as long as they fit.
_SNIPPETS = f"""
    {_DOC_LINES}, {_TOP},
    entries as (
      select review_id, file_path, file_rank,
        list_transform(lines, lambda x, i: lpad(cast(i as varchar), cast(greatest(4, length(cast(i as varchar))) as int), ' ') || '| ' || x) as entries
      from top where file_rank <= 10),
    fitting as (
      select *, len(list_filter(range(1, len(entries) + 1),
        lambda i: list_sum(list_transform(entries[1:i], lambda e: length(e) + 1)) <= {MAX_CHARS})) as n
      from entries),
    snippets as (
      select review_id, file_path, file_rank, array_to_string(
        case when n < len(entries) then list_append(entries[1:n], '{ai_prepare.TRUNCATED}') else entries end,
        chr(10)) as snippet from fitting)"""
ORACLES["ai_snippets"] = f"""
    with {_SNIPPETS} select review_id, file_path, length(snippet) as n_chars, md5(snippet) as digest from snippets"""
ORACLES["ai_prompts"] = f"""
    with {_SNIPPETS},
    texts as (
      select review_id, concat_ws(chr(10), 'Repository: own/' || review_id, 'Shape of the reply, one JSON object:',
        '{ai_prepare.ANSWER_FORMAT}', '', 'Numbered files:',
        string_agg('=== ' || file_path || ' ===' || chr(10) || snippet || chr(10), chr(10) order by file_rank),
        'Reply with the object alone. Nothing found means an empty list of issues.') as t
      from snippets group by review_id)
    select review_id, length(t) as n_chars, md5(t) as digest from texts"""

_ANSWERS = f"""
    a as (select o_orderkey, cast(o_orderkey as varchar) as review_id, o_orderkey % 11 as kind,
      o_orderkey % 11 in (3, 4, 5, 6, 7) as ok, 1 + o_orderkey % 3 as n from orders),
    listed as (select *, unnest(range(1, n + 1)) as i from a where ok and kind <> 5),
    named as (select *, case when kind = 3 and i = n then 'code_smell' else {_list(CATEGORIES)}[(o_orderkey + i) % 10 + 1] end as category,
      case when kind = 6 then 'medium' else {_list(SEVERITIES)}[(o_orderkey + i) % 5 + 1] end as severity from listed),
    items as (
      select review_id, 'f' || i || '.py' as file_path, case when kind = 7 and i = n then 3 else i * 5 end as line_start,
        case when i % 2 = 0 then null else i * 5 + 2 end as line_end, category, severity,
        cast(0.5 as double) as confidence, 'ai:' || category || ':' || i as rule_id, 'T' || i as title,
        'E' as explanation, 'S' as suggestion from named)"""
ORACLES["ai_parse_status"] = f"""
    with {_ANSWERS}
    select review_id, case when ok then 'completed' else 'failed' end as status,
      case when not ok then -1 when kind = 5 then 0 else n end as n_issues from a"""
ORACLES["ai_issues"] = f"with {_ANSWERS} select * from items"
_AI_FILES = f"""
    {_ANSWERS},
    sent as (select review_id, 'f' || f || '.py' as file_path from a, (values (1), (2), (9)) v(f) where ok),
    ai_results as (
      select s.review_id, s.file_path, 'python' as language, 10 as line_count, count(i.title) as issues_count,
        cast(100 - coalesce(sum({_PENALTY}), 0) as double) as file_score
      from sent s left join items i on i.review_id = s.review_id and i.file_path = s.file_path
      group by s.review_id, s.file_path)"""
ORACLES["ai_file_scores"] = (
    f"with {_AI_FILES} select * from ai_results".replace("sum(" + _PENALTY + ")", f"sum(case when i.title is not null then {_PENALTY} end)")
)
ORACLES["ai_review_summary"] = f"""
    with {_AI_FILES}, {_REVIEWS}, {_REPOS},
    per_review as (select review_id, count(*) as files, cast(printf('%.2f', sum(file_score) / count(*)) as double) as score
      from ai_results group by review_id)
    select a.review_id, case when ok then 'completed' else 'failed' end as status,
      case when ok then files else 0 end as files_analyzed,
      case when not ok or kind = 5 then 0 else n end as issues_count,
      case when ok then score else 0 end as overall_score,
      case when not ok then null when kind = 5 then 'none'
        when kind = 4 then 'AI review of 3 files in ' || owner || '/' || name || '. Found ' || n
          || ' issues with an overall score of ' || score || '.' else 'fine' end as summary
    from a join reviews_v v on v.id = a.review_id join repos_v p on p.id = v.repository_id
    left join per_review s on s.review_id = a.review_id""".replace(
    "sum(" + _PENALTY + ")", f"sum(case when i.title is not null then {_PENALTY} end)"
)

# ---- reports ----------------------------------------------------------------

_RR = f"""{_REVIEWS}, {_REPOS},
    rr as (select v.*, owner, name, url, default_branch from reviews_v v join repos_v p on p.id = v.repository_id)"""
_SUMMARY = """case when coalesce(summary, '') <> '' then summary else 'Review of ' || owner || '/' || name || ': '
    || issues_count || ' issues, score ' || overall_score || '.' end"""


def _file_name(ext: str) -> str:
    return f"owner || '-' || name || '-' || review_type || '-' || strftime(created_at, '%Y%m%d') || '.{ext}'"


ORACLES["report_summary"] = f"with {_RR} select id as review_id, {_SUMMARY} as summary from rr"
ORACLES["report_filename"] = f"""
    with {_RR} select id as review_id, {_file_name("md")} as markdown, {_file_name("json")} as json,
      {_file_name("summary")} as summary from rr"""
_ISSUE_TEXT = """concat_ws(chr(10), '#### ' || title, '', '- **Location:** `' || file_path || ':' || line_start
      || case when coalesce(line_end, 0) = 0 then '' else '-' || line_end end || '`',
      '- **Category:** ' || replace(category, '_', ' '), '- **Severity:** ' || severity,
      '- **Confidence:** ' || printf('%.0f', confidence * 100) || '%', '- **Rule:** `' || rule_id || '`', '',
      explanation, '', '**Suggestion:** ' || suggestion, '', '')"""
ORACLES["report_issue_lines"] = f"with {_ISSUES} select review_id, chr(10) || ({_ISSUE_TEXT})[:-2] as text from issues_v"
_MARKDOWN = f"""
    {_RR}, {_ISSUES}, {V.oracle_ctes("file_results_v")},
    tables as (
      select review_id, concat_ws(chr(10), '## File scores', '', '| File | Language | Issues | Score |',
        '| --- | --- | --- | --- |', string_agg('| `' || file_path || '` | ' || language || ' | ' || issues_count
          || ' | ' || printf('%.1f', file_score) || ' |', chr(10) order by string_split(file_path, '/')), '', '') as t
      from file_results_v group by review_id),
    groups as (
      select review_id, severity, {_SEVERITY_RANK} as rank, '### ' || upper(severity[1]) || severity[2:] || ' ('
        || count(*) || ')' || chr(10) || chr(10) || string_agg({_ISSUE_TEXT}, '' order by string_split(file_path, '/'),
          line_start, rule_id, title, line_end nulls first, explanation, suggestion) as t
      from issues_v group by review_id, severity),
    sections as (select review_id, string_agg(t, '' order by rank) as t from groups group by review_id),
    documents_md as (
      select id as review_id, concat_ws(chr(10), '# Code Review Report: ' || owner || '/' || name, '', '## Overview', '',
        '- **Repository:** [' || url || '](' || url || ')', '- **Review type:** ' || review_type,
        '- **Status:** ' || status, '- **Overall score:** ' || overall_score,
        '- **Files analyzed:** ' || files_analyzed, '- **Issues found:** ' || issues_count,
        '- **Created:** ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00'))
        || case when ai_model is null then '' else chr(10) || '- **AI model:** ' || ai_model end
        || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
        || case when coalesce(summary, '') = '' then '_No summary provided._' else summary end || chr(10) || chr(10)
        || coalesce(t.t, '') || '## Issues' || chr(10) || chr(10)
        || coalesce(s.t, '_No issues detected._' || chr(10) || chr(10)) as text, report_markdown
      from rr left join tables t on t.review_id = rr.id left join sections s on s.review_id = rr.id),
    bodies as (select review_id, text[:-2] as body, report_markdown from documents_md)"""
ORACLES["report_markdown"] = f"with {_MARKDOWN} select review_id, body from bodies"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')"
_ISSUE_FIELDS = """concat_ws(':', file_path, line_start, coalesce(line_end::varchar, '-'), category, severity,
    round(confidence * 1000)::bigint, rule_id, title, explanation, suggestion)"""
ORACLES["report_json"] = f"""
    with {_RR}, {_ISSUES}, {V.oracle_ctes("file_results_v")},
    f as (select review_id, md5(string_agg(concat_ws(':', file_path, language, line_count, issues_count, round(file_score * 1000)::bigint),
      ';' order by string_split(file_path, '/'))) as d from file_results_v group by review_id),
    i as (select review_id, md5(string_agg({_ISSUE_FIELDS}, ';' order by string_split(file_path, '/'),
      line_start, rule_id, title, line_end nulls first, explanation, suggestion)) as d from issues_v group by review_id)
    select id as review_id, id, repository_id, review_type, status, overall_score, files_analyzed, issues_count, summary, ai_model,
      error_message, cast(null as varchar) as started_at, {_ISO.format("completed_at")} as completed_at,
      {_ISO.format("created_at")} as created_at,
      concat_ws(' ', repository_id, owner, name, url, coalesce(default_branch, '-')) as repository,
      coalesce(f.d, md5('')) as files_digest, coalesce(i.d, md5('')) as issues_digest
    from rr left join f on f.review_id = rr.id left join i on i.review_id = rr.id"""
ORACLES["report_bundle"] = f"""
    with {_MARKDOWN}
    select id as review_id, 'markdown' as format, {_file_name("md")} as filename,
      'text/markdown; charset=utf-8' as media_type, md5(coalesce(b.report_markdown, body)) as digest
    from rr join bodies b on b.review_id = rr.id
    union all select id, 'json', {_file_name("json")}, 'application/json; charset=utf-8', null from rr
    union all select id, 'summary', {_file_name("summary")}, 'text/plain; charset=utf-8', md5({_SUMMARY}) from rr"""

ORACLES["report_stored"] = f"""
    with {_MARKDOWN}
    select id, issues_count, md5(body) as digest from rr join bodies b on b.review_id = rr.id
    where status = 'completed'"""

# ---- maintenance ------------------------------------------------------------

ORACLES["parse_repo_ref"] = """
    with x as (select c_custkey, c_custkey % 10 as kind, c_custkey as k from customer),
    r as (select c_custkey,
      case kind when 0 then 'owner' || k when 1 then 'o-' || k when 2 then 'owner' || k when 3 then 'owner' || k end as owner,
      case kind when 0 then 'repo.' || k when 1 then 'r_' || k when 2 then 'name' || k when 3 then 'name' end as name,
      case kind when 4 then 'empty' when 5 then 'not_owner_and_name' when 6 then 'unsupported_host'
        when 7 then 'not_owner_and_name' when 8 then 'forbidden_character' when 9 then 'invalid_owner' end as error from x)
    select *, 'https://github.com/' || owner || '/' || name as html_url,
      'https://github.com/' || owner || '/' || name || '.git' as clone_url from r"""
ORACLES["register_repositories"] = """
    with q as (select o_orderkey as seq, c_nationkey, c_custkey, o_orderkey % 50 = 0 as bad
               from orders join customer on c_custkey = o_custkey),
    v as (select *, row_number() over (partition by c_custkey, bad order by seq) as rn from q)
    select seq, cast(c_nationkey as varchar) as user_id, 'owner' || c_nationkey as owner,
      case when c_custkey % 2 = 0 then 'repo-' else 'new-' end || c_custkey as name,
      case when bad then 'invalid' when c_custkey % 2 = 0 or rn > 1 then 'duplicate' else 'registered' end as outcome,
      case when bad then 'invalid_length' end as error from v"""
ORACLES["apply_fetch_outcomes"] = f"""
    with {_REPOS}, l as (select cast(o_custkey as varchar) as id, max(o_orderkey) as o from orders group by 1)
    select id, case when o is null then status when o % 2 = 0 then 'ready' else 'failed' end as status,
      case when o % 2 = 0 then '/new/' || o else local_path end as local_path,
      case when o % 2 = 0 then 'trunk' else default_branch end as default_branch,
      case when o is null then error_message when o % 2 = 0 then null else 'failed in ' || o end as error_message,
      case when o % 2 = 0 then 1704067200 + o end as cloned_at,
      coalesce(1704067200 + o, 1709251200) as updated_at
    from repos_v left join l using (id)"""
ORACLES["create_reviews"] = """
    select cast(c_custkey as varchar) as repository_id, cast(c_nationkey as varchar) as user_id,
      case when c_custkey % 3 = 0 then 'ai' else 'static' end as review_type,
      case when c_custkey % 2 = 0 then 'running' else 'pending' end as status,
      case when c_custkey % 3 = 0 then 'qwen2.5' end as ai_model, cast(0 as double) as overall_score,
      c_custkey % 2 = 0 as started, 64 as id_length from customer"""
ORACLES["replace_results"] = f"""
    with {_REVIEWS}, m as (select cast(l_orderkey as varchar) as id, max('rule-' || l_suppkey % 20) as last_rule
      from lineitem group by 1)
    select id, case when status = 'failed' then 'completed' else status end as status,
      case when status = 'failed' then 'again' else summary end as summary, ai_model,
      case when status = 'failed' then '# new' else report_markdown end as report_markdown,
      case when status = 'failed' then 90 else overall_score end as overall_score,
      cast(null as varchar) as error_message,
      case when status = 'failed' then 1 else issues_count end as stored_issues,
      case when status = 'failed' then 'new-rule' else last_rule end as last_rule
    from reviews_v left join m using (id)"""
ORACLES["schema_backfill"] = f"""
    with {_REVIEWS}
    select id, status, case when status = 'completed' then 'static' else review_type end as review_type,
      case when status <> 'completed' then ai_model end as ai_model,
      case when status <> 'completed' then report_markdown end as report_markdown from reviews_v"""
ORACLES["cascade_delete"] = f"""
    with {_REVIEWS}, {_REPOS},
    u as (select cast(n_nationkey as varchar) as id from nation where n_regionkey not in (0, 2)),
    p as (select id from repos_v where user_id in (select id from u) and status <> 'failed'),
    r as (select id, cast(id as bigint) as k from reviews_v where user_id in (select id from u)
      and repository_id in (select id from p) and not (status = 'running' and review_type = 'ai')),
    l as (select l_orderkey, l_partkey from lineitem where l_orderkey in (select k from r))
    select 'users' as table_name, count(*) as n_left from u
    union all select 'user_settings', count(*) from u
    union all select 'repositories', count(*) from p
    union all select 'reviews', count(*) from r
    union all select 'review_issues', count(*) from l
    union all select 'file_analysis_results', count(*) from (select distinct * from l)"""
ORACLES["audit_unique"] = f"""
    with {_REVIEWS},
    by_email as (select count(*) as n from customer where c_custkey % 9 = 0),
    by_id as (select count(*) as n from customer where c_custkey % 15 = 0),
    failed as (select repository_id, count(*) as n from reviews_v where status = 'failed' group by 1)
    select 'users' as table_name, 'not_unique' as kind, 'email' as column_name, 'same@x.io' as value, n as n_rows
      from by_email where n > 1
    union all select 'users', 'not_unique', 'github_id', '5', n from by_id where n > 1
    union all select 'reviews', 'not_unique', 'id', 'twice' || repository_id, n from failed where n > 1"""
_FILE_RESULTS, _SETTINGS = V.oracle_ctes("file_results_v"), V.oracle_ctes("settings_v")
ORACLES["audit_child_ids"] = f"""
    with {_ISSUES}, {_FILE_RESULTS}, {_SETTINGS}
    select 'review_issues' as table_name, 'id' as column_name, count(*) as n_values, 2 * count(*) as n_rows
      from issues_v where title in ('Title 7', 'Title 8')
    union all select 'file_analysis_results', 'id', count(*), 2 * count(*) from file_results_v where line_count > 60
    union all select 'user_settings', c, count(*), 2 * count(*) from settings_v, (values ('id'), ('user_id')) v(c)
      where max_file_size_bytes is not null group by c"""
ORACLES["audit_orphans"] = f"""
    with {_REVIEWS},
    running as (select repository_id, count(*) as n from reviews_v where status = 'running' group by 1),
    lost as (select id, issues_count as n from reviews_v where status = 'failed' and issues_count > 0)
    select 'repositories' as table_name, 'orphan' as kind, 'user_id' as column_name, 'nobody' as value,
      count(*) as n_rows from customer where c_custkey % 4 = 0
    union all select 'reviews', 'orphan', 'repository_id', '-' || repository_id, n from running
    union all select 'review_issues', 'orphan', 'review_id', id, n from lost"""
ORACLES["audit_domains"] = f"""
    with {_REVIEWS}, {_REPOS},
    v(table_name, kind, column_name, n_rows) as (
      select 'users', 'null', 'email', 0
      union all select 'repositories', 'null', 'name', (select count(*) from repos_v where status = 'pending')
      union all select 'repositories', 'too_long', 'owner', (select count(*) from repos_v where status = 'failed')
      union all select 'repositories', 'unknown_value', 'status', (select count(*) from repos_v where status = 'cloning')
      union all select 'reviews', 'unknown_value', 'review_type', (select count(*) from reviews_v where review_type = 'ai')
      union all select 'review_issues', 'unknown_value', 'severity', (select count(*) from lineitem where l_linenumber % 3 = 0)
      union all select 'review_issues', 'out_of_range', 'confidence', (select count(*) from lineitem where l_discount * 10 * 2 > 1))
    select * from v where n_rows > 0"""
ORACLES["primary_email"] = """
    select c_custkey, case when c_custkey % 4 = 0 then 'public' || c_custkey || '@x.io'
      when c_custkey % 6 <> 0 and c_custkey % 5 <> 0 then 'second@x.io'
      when c_custkey % 7 = 0 then 'third@x.io' end as email from customer"""
ORACLES["resolve_accounts"] = f"""
    with {V.oracle_ctes("users_v")},
    s as (select s_suppkey as k, s_suppkey % 4 as kind, s_name from supplier),
    last as (select k, kind, 'name' || k || '-1' as github_username, 'http://a/1' as avatar_url,
      case when kind = 0 then k * 3 else 1000000 + k * 2 + 1 end as github_id,
      -- names: copy d has one when k + d is odd
      case when k % 2 = 1 then s_name || '-0' else s_name || '-1' end as first_name,
      case when (k + 1) % 2 = 1 then s_name || '-1' end as last_name from s),
    m as (select last.*, u.id, u.full_name, u.email, u.auth_provider from last left join users_v u
      on (kind = 0 and u.github_id = last.github_id) or (kind = 1 and u.email = 'c' || k || '@x.io'))
    select case when id is null then 'create' when kind = 0 then 'update' else 'link' end as action, id as user_id,
      case when kind = 1 then 'c' || k || '@x.io' else 's' || k || '@y.io' end as email,
      case when kind = 0 and id is not null then coalesce(last_name, full_name)
        when kind = 0 then last_name
        else coalesce(full_name, first_name) end as full_name,
      github_id, github_username, avatar_url, 'github' as auth_provider from m"""
ORACLES["merge_accounts"] = f"""
    with {V.oracle_ctes("users_v")},
    p as (select s_suppkey as k, s_suppkey % 4 as kind, s_name, 'name' || s_suppkey as username,
      case when s_suppkey % 4 = 0 then s_suppkey * 3 else 1000000 + s_suppkey end as github_id,
      case when s_suppkey % 4 = 1 then 'c' || s_suppkey || '@x.io' else 's' || s_suppkey || '@y.io' end as email
      from supplier where s_suppkey % 5 <> 0),
    m as (select p.*, u.id, u.full_name as old_name, u.auth_provider as old_provider from p left join users_v u
      on (kind = 0 and u.github_id = p.github_id) or (kind = 1 and u.email = p.email))
    select coalesce(m.id, 'new') as id, email, case when id is null or kind = 0 then s_name else coalesce(nullif(old_name, ''), s_name) end as full_name,
      github_id, username as github_username, case when kind = 1 and old_provider <> 'local' then old_provider else 'github' end as auth_provider from m
    union all
    select id, email, full_name, github_id, github_username, auth_provider from users_v
    where id not in (select id from m where id is not null)"""
ORACLES["register_accounts"] = """
    with q as (select o_orderkey as seq, o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as rn
      from orders)
    select seq, case when k % 2 = 0 then 'c' || k || '@x.io' else 'new' || k || '@z.io' end as email,
      case when rn > 1 or k % 2 = 0 and k in (select c_custkey from customer) then 'duplicate_email'
        else 'registered' end as outcome from q"""
