"""The registered queries: each runs library code over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance import views as V
from lintmill.functions import repo_ref, text
from lintmill.operators import (
    ai_ingest,
    ai_prepare,
    catalogue,
    duplicates,
    joins,
    line_rules,
    long_functions,
    maintenance,
    python_facts,
    python_rules,
    reports,
    scoring,
    search,
    settings,
    text_index,
)
from lintmill.plans import ai_review, export, static_review
from lintmill.schemas import DEFAULT_SETTINGS
from lintmill.session import checkpoint_dir
from lintmill.sources import corpus, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _day(column: str = "created_at") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# ---- scan and filters -------------------------------------------------------


def _default_list(name: str) -> Column:
    return text.csv_list(F.lit(DEFAULT_SETTINGS[name]))


def _user_settings(spark: SparkSession, sf: str) -> DataFrame:
    users = V.catalogue(spark, sf, "users_v").select(F.col("id").alias("user_id"))
    return settings.effective_settings(users, V.catalogue(spark, sf, "settings_v"))


@query
def scan_order(spark, sf):
    kept = corpus.analyzable(V.paths_v(spark, sf))
    placed = joins.position_within(kept, ["review_id"], [F.asc(text.path_key(F.col("file_path"))), F.asc("doc_id")])
    return placed.select("doc_id", "review_id", "file_path", "language", "position")


@query
def corpus_scan(spark, sf):
    """Files on disk, listed, chosen, opened and put in order."""
    files = corpus.read_corpus(spark, V.corpus_on_disk(spark, sf), repository_depth=1)
    doc_id = F.regexp_extract("file_path", "^d([0-9]+)/", 1).cast("long")
    return files.select(
        doc_id.alias("doc_id"), "review_id", "file_path", "language", "size_bytes", F.sha2("content", 256).alias("digest")
    )


@query
def detect_language(spark, sf):
    language = F.coalesce(text.language_of(F.col("file_path")), F.lit("unknown"))
    return V.paths_v(spark, sf).select("doc_id", language.alias("language"))


@query
def filter_ignored_folders(spark, sf):
    keep = corpus.outside_folders(F.col("file_path"), _default_list("ignored_folders"))
    return V.paths_v(spark, sf).where(keep).select("doc_id")


@query
def filter_ignored_ext(spark, sf):
    keep = corpus.without_extensions(F.col("file_path"), _default_list("ignored_extensions"))
    return V.paths_v(spark, sf).where(keep).select("doc_id")


@query
def filter_size(spark, sf):
    limits = _user_settings(spark, sf).select("user_id", "max_file_size_bytes")
    files = V.paths_v(spark, sf).join(limits, "user_id")
    return files.where(F.col("size_bytes") <= F.col("max_file_size_bytes")).select("doc_id")


@query
def analyzable_files(spark, sf):
    kept = corpus.analyzable(V.paths_v(spark, sf), _user_settings(spark, sf))
    return kept.select("doc_id", "user_id", "language")


@query
def settings_lists(spark, sf):
    lists = settings.settings_lists(_user_settings(spark, sf))
    return lists.select(
        "user_id",
        F.array_join("ignored_folder_list", "|").alias("folders"),
        F.array_join("ignored_extension_list", "|").alias("extensions"),
    )


@query
def effective_settings(spark, sf):
    return _user_settings(spark, sf)


@query
def patch_settings(spark, sf):
    patches = spark.sql(
        """select 'u' || cast(c_custkey as string) as user_id, p.col1 as seq, p.col2 as changes
           from {customer} lateral view inline(
             case c_custkey % 7
               when 1 then array((1, map('ollama_model', 'p1')), (2, map('ollama_model', cast(null as string))))
               when 2 then array((1, map('ollama_model', 'p1', 'max_file_size_bytes', '5000')),
                                 (2, map('ignored_folders', 'x')))
               when 3 then array((1, map('ollama_base_url', '')), (2, map('ignored_extensions', '.q')))
               when 4 then array((1, cast(map() as map<string, string>)))
               when 5 then array((2, map('max_file_size_bytes', '7777')),
                                 (1, map('max_file_size_bytes', cast(null as string))))
               when 6 then array((1, map('ignored_extensions', '.a')), (2, map('ignored_extensions', '')))
             end) p""",
        customer=V.table(spark, sf, "customer"),
    )
    return settings.patch_settings(V.catalogue(spark, sf, "settings_v"), patches)


@query
def validate_settings(spark, sf):
    updates = spark.sql(
        """select 'u' || cast(c_custkey as string) as user_id,
             case c_custkey % 9 when 0 then 'ftp://x' when 1 then '  HTTPS://ok' when 2 then ''
               when 3 then 'http://' || repeat('a', 506) when 4 then 'http://' || repeat('a', 505) end as ollama_base_url,
             case c_custkey % 9 when 5 then repeat('m', 129) when 6 then repeat('m', 128) end as ollama_model,
             cast(case c_custkey % 4 when 0 then 1023 when 1 then 1024 when 2 then 10485761 end as int)
               as max_file_size_bytes
           from {customer}""",
        customer=V.table(spark, sf, "customer"),
    )
    return settings.validate_settings(updates).select(
        "user_id", F.coalesce("error", F.lit("accepted")).alias("outcome")
    )


# ---- texts and rules --------------------------------------------------------


@query
def decode_text(spark, sf):
    raw = F.concat(F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8"), F.unhex(F.lit("0DC328")))
    decoded = text.decode(raw)
    return V.table(spark, sf, "documents").select(
        "doc_id", F.length(decoded).alias("n_chars"), F.sha2(decoded, 256).alias("digest")
    )


@query
def lines(spark, sf):
    rows = text.explode_lines(V.docs_files(spark, sf), "file_path")
    return rows.select("file_path", "line_no", F.length("line").alias("n_chars"), F.md5("line").alias("digest"))


def _places(issues: DataFrame) -> DataFrame:
    return issues.select(
        "review_id", "file_path", "line_start", "line_end", "category", "severity", "confidence", "rule_id"
    )


@query
def rule_long_line(spark, sf):
    return _places(line_rules.line_issues(V.docs_files(spark, sf), {"long-line"}))


@query
def rule_secret(spark, sf):
    return _places(line_rules.line_issues(V.docs_files(spark, sf), {"hardcoded-api-key"}))


@query
def rule_todo(spark, sf):
    return _places(line_rules.line_issues(V.code_files(spark, sf), {"todo-comment"}))


@query
def rule_aws_key(spark, sf):
    return _places(line_rules.line_issues(V.code_files(spark, sf), {"aws-access-key"}))


@query
def common_rules(spark, sf):
    """All common line rules at once over code of every language."""
    ids = {"long-line", "todo-comment", "hardcoded-api-key", "aws-access-key"}
    return _places(line_rules.line_issues(V.code_files(spark, sf), ids))


def _language_rules(name: str, languages: list[str], prefix: str) -> None:
    def run(spark, sf):
        files = V.code_files(spark, sf).where(F.col("language").isin(languages))
        found = line_rules.line_issues(files)
        return _places(found.where(F.col("rule_id").startswith(prefix)))

    QUERIES[name] = run


for _name, _languages, _prefix in [
    ("rules_js", ["javascript", "typescript"], "js-"),
    ("rules_java", ["java"], "java-"),
    ("rules_go", ["go"], "go-"),
    ("rules_rust", ["rust"], "rust-"),
    ("rules_csharp", ["csharp"], "csharp-"),
    ("rules_cpp", ["cpp"], "cpp-"),
]:
    _language_rules(_name, _languages, _prefix)


@query
def rules_js_pages(spark, sf):
    found = line_rules.line_issues(V.page_files(spark, sf))
    return _places(found.where(F.col("rule_id").startswith("js-")))


@query
def rule_large_file(spark, sf):
    return _places(line_rules.large_file_issues(V.large_files(spark, sf)))


@query
def long_functions_js(spark, sf):
    issues = long_functions.long_function_issues(V.script_files(spark, sf))
    name = F.regexp_extract("title", "'(.*)'", 1)
    return issues.select("review_id", "file_path", "line_start", "line_end", name.alias("name"))


def _python_rule(key: str, rule_id: str) -> None:
    def run(spark, sf):
        facts = python_facts.python_facts(V.python_files(spark, sf), {rule_id})
        return _places(python_rules.python_issues(facts).where(F.col("rule_id") == rule_id))

    QUERIES[key] = run


for _key, _rule in [
    ("py_module_doc", "missing-module-docstring"),
    ("py_short_name", "short-function-name"),
    ("py_long_function", "long-function"),
    ("py_function_doc", "missing-function-docstring"),
    ("py_complexity", "high-cyclomatic-complexity"),
    ("py_class_doc", "missing-class-docstring"),
    ("py_eval", "python-eval-exec"),
    ("py_shell_true", "subprocess-shell-true"),
]:
    _python_rule(_key, _rule)


@query
def py_unused_import(spark, sf):
    facts = python_facts.python_facts(V.python_files(spark, sf), {"unused-import"})
    issues = python_rules.python_issues(facts).where(F.col("rule_id") == "unused-import")
    name = F.regexp_extract("title", "'(.*)'", 1)
    return issues.select("review_id", "file_path", "line_start", name.alias("name"))


@query
def py_syntax_error(spark, sf):
    facts = python_facts.python_facts(V.python_files(spark, sf, broken=True), {"python-syntax-error"})
    return _places(python_rules.python_issues(facts).where(F.col("rule_id") == "python-syntax-error"))


@query
def py_all_rules(spark, sf):
    """Every Python rule over modules of which some cannot be parsed."""
    facts = python_facts.python_facts(V.python_files(spark, sf, broken=True))
    return python_rules.python_issues(facts).groupBy("file_path", "rule_id").agg(F.count("*").alias("n"))


@query
def shingles(spark, sf):
    rows = duplicates.shingles(V.docs_files(spark, sf))
    return rows.select("review_id", "file_path", "line_start", F.lower(F.hex("fingerprint")).alias("digest"))


def _duplicate_places(issues: DataFrame) -> DataFrame:
    other = F.regexp_extract("explanation", r"stand in (.*) from line (\d+)\.", 1)
    other_line = F.regexp_extract("explanation", r"stand in (.*) from line (\d+)\.", 2).cast("int")
    return issues.select(
        "review_id", "file_path", "line_start", "line_end", other.alias("other_path"), other_line.alias("other_line")
    )


@query
def dup_blocks(spark, sf):
    return _duplicate_places(duplicates.duplicate_issues(V.docs_files(spark, sf)))


@query
def dup_blocks_one_review(spark, sf):
    """The same documents as one repository."""
    files = V.docs_files(spark, sf).withColumn("review_id", F.lit("all"))
    return _duplicate_places(duplicates.duplicate_issues(files))


# ---- scores -----------------------------------------------------------------


def _docs_reviews(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A review per source, an empty one beside it, and their repositories."""
    documents = V.table(spark, sf, "documents")
    reviews = spark.sql(
        """select distinct p || source as id, source as repository_id
           from {documents} lateral view explode(array('', 'empty-')) t as p""",
        documents=documents,
    )
    repositories = spark.sql(
        "select distinct source as id, 'own' as owner, source as name from {documents}", documents=documents
    )
    return reviews, repositories


def _docs_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scanned = static_review.Scanned(V.docs_files(spark, sf))
    issues = static_review.all_issues(scanned)
    return static_review.scored_files(scanned, issues), issues


@query
def all_issues(spark, sf):
    issues = static_review.all_issues(V.docs_files(spark, sf))
    return issues.groupBy("review_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query
def file_results(spark, sf):
    return _docs_results(spark, sf)[0]


@query
def file_scores(spark, sf):
    return _docs_results(spark, sf)[0].select("review_id", "file_path", "file_score")


@query
def review_scores(spark, sf):
    reviews, _ = _docs_reviews(spark, sf)
    return scoring.review_scores(_docs_results(spark, sf)[0], reviews)


@query
def review_summary(spark, sf):
    results, issues = _docs_results(spark, sf)
    return scoring.review_summaries(results, issues, *_docs_reviews(spark, sf))


def _static_review(spark: SparkSession, sf: str) -> static_review.StaticReview:
    """The whole job over files of every language."""
    return static_review.run_static_review(V.mixed_files(spark, sf), *V.mixed_reviews(spark, sf), F.lit("2024-05-01").cast("timestamp"))


@query
def static_review_issues(spark, sf):
    issues = _static_review(spark, sf).issues
    return issues.groupBy("review_id", "file_path", "rule_id", "severity").agg(F.count("*").alias("n"), F.sum("line_start").alias("lines"))


@query
def static_review_files(spark, sf):
    return _static_review(spark, sf).file_results


@query
def static_review_summary(spark, sf):
    return _static_review(spark, sf).reviews.select(
        "review_id", "status", "files_analyzed", "issues_count", "overall_score", "summary"
    )


@query
def severity_counts(spark, sf):
    return scoring.severity_counts(V.catalogue(spark, sf, "issues_v"))


# ---- catalogue --------------------------------------------------------------


def _catalogue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        V.catalogue(spark, sf, "reviews_v"),
        V.catalogue(spark, sf, "repos_v"),
        V.catalogue(spark, sf, "issues_v"),
    )


@query
def review_by_id(spark, sf):
    reviews, _, issues = _catalogue(spark, sf)
    detail = catalogue.review_detail(reviews, issues, V.catalogue(spark, sf, "file_results_v"))
    return catalogue.review_overview(detail).select(
        "review_id", "user_id", "status", "issues_loaded", "files_loaded"
    )


@query
def ready_gate(spark, sf):
    requests = spark.sql(
        """select o_orderkey as request,
             cast(case when o_orderkey % 5 = 0 then o_custkey + 1000000000 else o_custkey end as string) as repository_id,
             cast(case when o_orderkey % 3 = 0 then c_nationkey + 1 else c_nationkey end as string) as user_id
           from {orders} join {customer} on c_custkey = o_custkey""",
        orders=V.table(spark, sf, "orders"),
        customer=V.table(spark, sf, "customer"),
    )
    gated = catalogue.ready_gate(requests, V.catalogue(spark, sf, "repos_v"))
    return gated.select("request", "outcome")


@query
def list_reviews(spark, sf):
    placed = catalogue.reviews_in_order(V.catalogue(spark, sf, "reviews_v"))
    return placed.select("user_id", "repository_id", "id", "position")


@query
def list_repositories(spark, sf):
    repos = V.catalogue(spark, sf, "repos_v")
    totals = catalogue.list_totals(repos, ["user_id"])
    placed = catalogue.repositories_in_order(repos).join(totals, "user_id")
    return placed.select("user_id", "id", "status", "position", "total")


@query
def latest_review(spark, sf):
    latest = catalogue.latest_reviews(V.catalogue(spark, sf, "reviews_v"))
    return latest.select("repository_id", "user_id", "id", "status", "issues_count")


@query
def latest_review_by_type(spark, sf):
    latest = catalogue.latest_reviews(V.catalogue(spark, sf, "reviews_v"), by_type=True)
    return latest.select("repository_id", "user_id", "review_type", "id")


@query
def dashboard(spark, sf):
    reviews, repos, _ = _catalogue(spark, sf)
    return catalogue.dashboard(repos, reviews)


def _search(spark: SparkSession, sf: str, **params) -> DataFrame:
    return search.search(*_catalogue(spark, sf), search.SearchParams(**params))


@query
def search_reviews(spark, sf):
    found = _search(spark, sf)
    return found.withColumn("created_at", _day())


def _filtered(name: str, **params) -> None:
    QUERIES[name] = lambda spark, sf: _search(spark, sf, **params).select("user_id", "id")


_filtered("search_filters", review_type="static", status="completed")
_filtered("search_score_range", min_score=20.0, max_score=60.0)
_filtered("search_date_range", from_date=datetime(1996, 1, 1), to_date=datetime(1997, 6, 30))
_filtered("search_by_severity", severity="critical")
_filtered("search_text", q=" TITLE 7 ")
_filtered("search_text_wildcard", q="order_%9")


def _indexed(name: str, **params) -> None:
    """The same searches through an index of all texts."""

    def run(spark, sf):
        reviews, repos, issues = _catalogue(spark, sf)
        index = text_index.TextIndex(spark, f"{checkpoint_dir(spark)}/lintmill/{uuid.uuid4().hex}/index")
        texts = text_index.issue_texts(issues).unionByName(text_index.own_texts(reviews))
        index.append(texts, reviews.select(F.col("id").alias("review_id")))
        return search.search(reviews, repos, issues, search.SearchParams(**params), index).select("user_id", "id")

    QUERIES[name] = run


_indexed("search_text_index", q=" TITLE 7 ")
_indexed("search_wildcard_index", q="order_%9")
_indexed("search_index_filters", q="explains 1", status="completed", min_score=20.0)


@query
def search_total(spark, sf):
    return search.search_total(_search(spark, sf, severity="high", min_score=50.0))


def _sorted(name: str, sort: str) -> None:
    def run(spark, sf):
        placed = search.search_positions(_search(spark, sf), sort)
        return placed.select("user_id", "id", "position")

    QUERIES[name] = run


_sorted("search_sort_score", "overall_score")
_sorted("search_sort_score_down", "-overall_score")
_sorted("search_sort_issues", "-issues_count")
_sorted("search_sort_issues_up", "issues_count")
_sorted("search_sort_created", "-created_at")
_sorted("search_sort_created_up", "created_at")


@query
def search_page(spark, sf):
    params = search.SearchParams(status="completed", sort="-overall_score", offset=5, limit=10)
    page = search.search_page(search.search(*_catalogue(spark, sf), params), params)
    return page.select("user_id", "position", "id", "repository_name", "overall_score")


# ---- language-model reviews -------------------------------------------------


@query
def ai_top_files(spark, sf):
    chosen = ai_prepare.top_files(V.docs_files(spark, sf).select("review_id", "file_path"))
    return chosen.select("review_id", "file_path", "file_rank")


@query
def ai_snippets(spark, sf):
    rows = ai_prepare.snippets(V.docs_files(spark, sf))
    return rows.select("review_id", "file_path", F.length("snippet").alias("n_chars"), F.md5("snippet").alias("digest"))


def _prepared(spark: SparkSession, sf: str) -> ai_review.Prepared:
    return ai_review.prepare(V.docs_files(spark, sf), *_docs_reviews(spark, sf))


@query
def ai_prepared_files(spark, sf):
    return _prepared(spark, sf).chosen


@query
def ai_without_files(spark, sf):
    return _prepared(spark, sf).without_files


@query
def ai_prompts(spark, sf):
    rows = ai_prepare.prompts(ai_prepare.snippets(V.docs_files(spark, sf)), *_docs_reviews(spark, sf))
    return rows.select("review_id", F.length("user_prompt").alias("n_chars"), F.md5("user_prompt").alias("digest"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer per order with 1 to 3 issues; what is wrong with it depends on key % 11."""
    from lintmill.schemas import CATEGORIES, SEVERITIES

    def names(values: list[str]) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    return spark.sql(
        f"""with shaped as (
              select o_orderkey, o_orderkey % 11 as kind, int(1 + o_orderkey % 3) as n from {{orders}}),
            listed as (
              select o_orderkey, kind, array_join(transform(sequence(1, n), i -> concat(
                '{{{{"file_path": "f', i, '.py", "line_start": ',
                case when i < n then string(i * 5) when kind = 2 then '0' when kind = 7 then '"3"' when kind = 8 then '3.5'
                  else string(i * 5) end,
                ', "line_end": ', case when i % 2 = 0 then 'null' else string(i * 5 + 2) end,
                ', "category": "', case when i = n and kind = 3 then 'Mystery'
                  else {names(CATEGORIES)}[int((o_orderkey + i) % 10)] end,
                '", "severity": "', case when kind = 3 then upper({names(SEVERITIES)}[int((o_orderkey + i) % 5)])
                  when kind = 6 then 'grave' else {names(SEVERITIES)}[int((o_orderkey + i) % 5)] end,
                '", "confidence": ', case when i = n and kind = 1 then '1.5' else '0.5' end,
                case when i = n and kind = 10 then '' else concat(', "title": "T', i, '"') end,
                ', "explanation": "E", "suggestion": "S"}}}}')), ', ') as items from shaped)
            select cast(o_orderkey as string) as review_id,
              case kind when 0 then concat('{{{{"summary": "cut", "issues": [', items)
                when 5 then '{{{{"summary": " none " }}}}'
                when 9 then concat('{{{{"summary": "s", "issues": [', items, ']}}}} trailing')
                else concat('{{{{"summary": "', case when kind = 4 then '  ' else 'fine' end, '", "issues": [',
                  items, ']}}}}') end as raw
            from listed""",
        orders=V.corpus_table(spark, sf, "orders", "o_orderkey"),
    )


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Files f1, f2 and f9 were sent for every order."""
    return spark.sql(
        """select cast(o_orderkey as string) as review_id, 'f' || f || '.py' as file_path, 'python' as language,
             cast(10 as int) as line_count
           from {orders} lateral view explode(array('1', '2', '9')) t as f""",
        orders=V.table(spark, sf, "orders"),
    )


@query
def ai_parse_status(spark, sf):
    parsed = ai_ingest.parse_answers(_answers(spark, sf))
    return parsed.select("review_id", "status", F.coalesce(F.size("issues"), F.lit(-1)).alias("n_issues"))


@query
def ai_issues(spark, sf):
    return ai_ingest.ai_issues(ai_ingest.parse_answers(_answers(spark, sf)))


def _ingested(spark: SparkSession, sf: str) -> ai_review.Ingested:
    reviews, repos, _ = _catalogue(spark, sf)
    at = F.lit("2024-05-01").cast("timestamp")
    return ai_review.ingest(_answers(spark, sf), _chosen(spark, sf), reviews, repos, at)


@query
def ai_file_scores(spark, sf):
    return _ingested(spark, sf).file_results


@query
def ai_review_summary(spark, sf):
    return _ingested(spark, sf).reviews.select(
        "review_id", "status", "files_analyzed", "issues_count", "overall_score", "summary"
    )


# ---- reports ----------------------------------------------------------------


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    reviews, repos, _ = _catalogue(spark, sf)
    return reports.with_repository(reviews, repos)


def _children(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.catalogue(spark, sf, "file_results_v"), V.catalogue(spark, sf, "issues_v")


@query
def report_summary(spark, sf):
    joined = _joined(spark, sf)
    return joined.select("review_id", reports.report_summary(joined).alias("summary"))


@query
def report_filename(spark, sf):
    return _joined(spark, sf).select(
        "review_id", *[reports.report_filename(f).alias(f) for f in ("markdown", "json", "summary")]
    )


@query
def report_issue_lines(spark, sf):
    issues = V.catalogue(spark, sf, "issues_v")
    return issues.select("review_id", reports.issue_markdown().alias("text"))


@query
def report_markdown(spark, sf):
    reviews, repos, _ = _catalogue(spark, sf)
    return reports.whole_texts(export.export_markdown(reviews, repos, *_children(spark, sf)))


@query
def report_json(spark, sf):
    """All fields of all lists, in their order."""
    reviews, repos, _ = _catalogue(spark, sf)
    built = reports.whole_texts(export.export_json(reviews, repos, *_children(spark, sf)), commas=True)
    shape = """review struct<id: string, repository_id: string, review_type: string, status: string, overall_score: double,
          files_analyzed: int, issues_count: int, summary: string, ai_model: string, error_message: string,
          started_at: string, completed_at: string, created_at: string>,
        repository struct<id: string, owner: string, name: string, url: string, default_branch: string>,
        file_results array<struct<file_path: string, language: string, line_count: int, issues_count: int, file_score: double>>,
        issues array<struct<file_path: string, line_start: int, line_end: int, category: string, severity: string,
          confidence: double, rule_id: string, title: string, explanation: string, suggestion: string>>"""
    parsed = built.select("review_id", F.from_json("body", shape, {"mode": "FAILFAST"}).alias("j"))

    def text(value: Column, kind: str = "") -> Column:
        value = F.round(value * 1000).cast("long") if kind == "number" else value
        return F.coalesce(value.cast("string"), F.lit("-"))

    def listed(array: str, fields: str, numbers: tuple[str, ...]) -> Column:
        one = lambda e: F.concat_ws(":", *[text(e[f], "number" if f in numbers else "") for f in fields.split()])
        return F.md5(F.array_join(F.transform(array, one), ";"))

    review = F.col("j.review")
    return parsed.select(
        "review_id",
        *[review[f].alias(f) for f in ("id", "repository_id", "review_type", "status", "overall_score", "files_analyzed", "issues_count",
                                       "summary", "ai_model", "error_message", "started_at", "completed_at", "created_at")],
        F.concat_ws(" ", *[text(F.col("j.repository")[f]) for f in ("id", "owner", "name", "url", "default_branch")]).alias("repository"),
        listed("j.file_results", "file_path language line_count issues_count file_score", ("file_score",)).alias("files_digest"),
        listed(
            "j.issues", "file_path line_start line_end category severity confidence rule_id title explanation suggestion", ("confidence",)
        ).alias("issues_digest"),
    )


@query
def report_bundle(spark, sf):
    reviews, repos, _ = _catalogue(spark, sf)
    parts = export.export_reports(reviews, repos, *_children(spark, sf))
    found = []
    # The parts of a format lie by review, and names and bodies meet there. Of each body, the JSON ones included, only its digest goes on.
    for f in ("markdown", "json", "summary"):
        own = parts.where(F.col("format") == f)
        bodies = reports.whole_texts(own, commas=f == "json").select("review_id", F.md5("body").alias("_digest"))
        digest = F.when(F.col("format") != "json", F.col("_digest"))
        found.append(
            reports.report_names(own).join(bodies, "review_id").select("review_id", "format", "filename", "media_type", digest.alias("digest"))
        )
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def report_stored(spark, sf):
    """Completed reviews get fresh Markdown, as after a run."""
    reviews, repos, _ = _catalogue(spark, sf)
    done = reviews.where(F.col("status") == "completed")
    stored = export.store_markdown(done, repos, *_children(spark, sf))
    return stored.select("id", "issues_count", F.md5("report_markdown").alias("digest"))


# ---- maintenance ------------------------------------------------------------


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """A repository reference per customer, its shape by key % 10."""
    return spark.sql(
        """select c_custkey, cast(c_nationkey as string) as user_id,
             case c_custkey % 10
               when 0 then ' https://github.com/owner' || k || '/repo.' || k || ' '
               when 1 then 'http://www.GitHub.com/o-' || k || '/r_' || k || '.git?tab=1#x'
               when 2 then 'github.com/owner' || k || '/name' || k || '/'
               when 3 then 'owner' || k || '/name.git'
               when 4 then '   '
               when 5 then 'only' || k
               when 6 then 'https://notgithub.com/a' || k || '/b'
               when 7 then 'https://github.com/a' || k || '/b/tree'
               when 8 then 'own' || k || '/re;po'
               else '-own' || k || '/repo' end as url
           from (select *, cast(c_custkey as string) as k from {customer})""",
        customer=V.table(spark, sf, "customer"),
    )


@query
def parse_repo_ref(spark, sf):
    parsed = _references(spark, sf).withColumn("r", repo_ref.parse_repo_ref(F.col("url")))
    owner, name = F.col("r.owner"), F.col("r.name")
    return parsed.select(
        "c_custkey",
        owner.alias("owner"),
        name.alias("name"),
        F.col("r.error").alias("error"),
        repo_ref.html_url(owner, name).alias("html_url"),
        repo_ref.clone_url(owner, name).alias("clone_url"),
    )


@query
def register_repositories(spark, sf):
    """Requests for own repositories (known if the key is even), each made by two orders or so."""
    requests = spark.sql(
        """select cast(c_nationkey as string) as user_id, o_orderkey as seq,
             'github.com/owner' || cast(c_nationkey as string) || '/'
               || case when c_custkey % 2 = 0 then 'repo-' else 'new-' end || cast(c_custkey as string) as url,
             case when o_orderkey % 50 = 0 then repeat('b', 256) else 'main' end as branch
           from {orders} join {customer} on c_custkey = o_custkey""",
        orders=V.corpus_table(spark, sf, "orders", "o_orderkey"),
        customer=V.table(spark, sf, "customer"),
    )
    decided = maintenance.register_repositories(requests, V.catalogue(spark, sf, "repos_v"))
    return decided.select("seq", "user_id", "owner", "name", "outcome", "error")


@query
def apply_fetch_outcomes(spark, sf):
    outcomes = spark.sql(
        """select cast(o_custkey as string) as repository_id, o_orderkey % 2 = 0 as ok,
             '/new/' || cast(o_orderkey as string) as local_path, 'trunk' as default_branch,
             'failed in ' || cast(o_orderkey as string) as message,
             cast('2024-01-01 00:00:00' as timestamp) + cast(o_orderkey as int) * interval '1' second as at
           from {orders}""",
        orders=V.table(spark, sf, "orders"),
    )
    merged = maintenance.apply_fetch_outcomes(V.catalogue(spark, sf, "repos_v"), outcomes)
    return merged.select(
        "id", "status", "local_path", "default_branch", "error_message",
        F.unix_timestamp("cloned_at").alias("cloned_at"), F.unix_timestamp("updated_at").alias("updated_at"),
    )


@query
def create_reviews(spark, sf):
    requests = spark.sql(
        """select cast(c_custkey as string) as repository_id, cast(c_nationkey as string) as user_id,
             case c_custkey % 3 when 0 then 'ai' when 1 then 'static' end as review_type,
             case when c_custkey % 2 = 0 then 'running' end as status
           from {customer}""",
        customer=V.table(spark, sf, "customer"),
    )
    rows = sinks.create_reviews(requests, F.lit("2024-05-01 00:00:00").cast("timestamp"))
    return rows.select(
        "repository_id", "user_id", "review_type", "status", "ai_model", "overall_score",
        F.col("started_at").isNotNull().alias("started"), F.length("id").alias("id_length"),
    )


@query
def replace_results(spark, sf):
    """Reviews of part orders (status P) are run again and get one new issue each."""
    reviews, _, issues = _catalogue(spark, sf)
    again = reviews.where(F.col("status") == "failed").select(F.col("id").alias("review_id"))
    new = again.select(
        "review_id", F.lit("new.py").alias("file_path"), F.lit(1).alias("line_start"),
        F.lit(None).cast("int").alias("line_end"), F.lit("bug").alias("category"), F.lit("high").alias("severity"),
        F.lit(0.5).alias("confidence"), F.lit("new-rule").alias("rule_id"), F.lit("New").alias("title"),
        F.lit("E").alias("explanation"), F.lit("S").alias("suggestion"),
    )
    stored = sinks.replace_children(issues, new, again)
    results = again.select(
        "review_id", F.lit("completed").alias("status"), F.lit(1).alias("files_analyzed"),
        F.lit(1).alias("issues_count"), F.lit(90.0).alias("overall_score"), F.lit("again").alias("summary"),
        F.lit(None).cast("string").alias("error_message"), F.lit("2024-05-01").cast("timestamp").alias("completed_at"),
        F.lit(None).cast("string").alias("ai_model"), F.lit("# new").alias("report_markdown"),
    )
    finished = sinks.finish_reviews(reviews, results)
    counts = stored.groupBy(F.col("review_id").alias("id")).agg(
        F.count("*").alias("stored_issues"), F.max("rule_id").alias("last_rule")
    )
    return finished.join(counts, "id", "left").select(
        "id", "status", "summary", "ai_model", "report_markdown", "overall_score", "error_message",
        F.coalesce("stored_issues", F.lit(0)).alias("stored_issues"), "last_rule",
    )


@query
def schema_backfill(spark, sf):
    """Old rows lack the later columns; new ones have them."""
    reviews = V.catalogue(spark, sf, "reviews_v")
    old = reviews.where(F.col("status") == "completed").drop("review_type", "ai_model", "report_markdown")
    merged = tables.merge_snapshots("reviews", old, reviews.where(F.col("status") != "completed"))
    return merged.select("id", "status", "review_type", "ai_model", "report_markdown")


def _all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    users = spark.sql("select cast(n_nationkey as string) as id from {nation}", nation=V.table(spark, sf, "nation"))
    reviews, repos, issues = _catalogue(spark, sf)
    return {
        "users": users,
        "user_settings": users.select(F.col("id").alias("user_id")),
        "repositories": repos,
        "reviews": reviews,
        "review_issues": issues,
        "file_analysis_results": V.catalogue(spark, sf, "file_results_v"),
    }


@query
def cascade_delete(spark, sf):
    """Delete users of nations with an even region, failed repositories and running AI reviews."""
    all_tables = _all_tables(spark, sf)
    users = spark.sql(
        "select cast(n_nationkey as string) as id from {nation} where n_regionkey in (0, 2)",
        nation=V.table(spark, sf, "nation"),
    )
    repos = all_tables["repositories"].where(F.col("status") == "failed").select("id")
    reviews = all_tables["reviews"].where(
        (F.col("status") == "running") & (F.col("review_type") == "ai")
    ).select("id")
    left = maintenance.cascade_delete(all_tables, users, repos, reviews)
    counts = [df.agg(F.count("*").alias("n_left")).select(F.lit(n).alias("table_name"), "n_left") for n, df in left.items()]
    union = counts[0]
    for c in counts[1:]:
        union = union.unionByName(c)
    return union


def _flawed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The catalogue with faults put in by key."""
    users = spark.sql(
        """select id, case when github_id % 9 = 0 then 'same@x.io' else email end as email,
             case when github_id % 5 = 0 then 5 else github_id end as github_id from {users}""",
        users=V.catalogue(spark, sf, "users_v"),
    )
    repos = spark.sql(
        """select id, case when cast(id as int) % 4 = 0 then 'nobody' else 'u' || id end as user_id,
             case when status = 'cloning' then 'cloned' else status end as status,
             case when status = 'failed' then repeat('o', 256) else owner end as owner,
             case when status = 'pending' then null else name end as name from {repos}""",
        repos=V.catalogue(spark, sf, "repos_v"),
    )
    reviews = spark.sql(
        """select case when status = 'failed' then 'twice' || repository_id else id end as id,
             'u' || repository_id as user_id,
             case when status = 'running' then '-' || repository_id else repository_id end as repository_id,
             case when review_type = 'ai' then 'AI' else review_type end as review_type, status
           from {reviews}""",
        reviews=V.catalogue(spark, sf, "reviews_v"),
    )
    issues = spark.sql(
        """select review_id, file_path, confidence * 2 as confidence, rule_id,
             case when line_end is null then 'grave' else severity end as severity, category, title
           from {issues}""",
        issues=V.catalogue(spark, sf, "issues_v"),
    )
    return {"users": users, "repositories": repos, "reviews": reviews, "review_issues": issues}


@query
def audit_unique(spark, sf):
    return maintenance.audit_unique(_flawed(spark, sf))


@query
def audit_child_ids(spark, sf):
    """Rows with made ids, some of them stored twice: violations by table."""
    views = {"review_issues": ("issues_v", "title in ('Title 7', 'Title 8')"), "file_analysis_results": ("file_results_v", "line_count > 60"),
             "user_settings": ("settings_v", "max_file_size_bytes is not null")}
    flawed = {}
    for name, (view, twice) in views.items():
        rows = maintenance.identified(V.catalogue(spark, sf, view), name)
        flawed[name] = rows.unionByName(rows.where(twice))
    found = maintenance.audit_unique(flawed)
    return found.groupBy("table_name", "column_name").agg(F.count("*").alias("n_values"), F.sum("n_rows").alias("n_rows"))


@query
def audit_orphans(spark, sf):
    return maintenance.audit_orphans(_flawed(spark, sf))


@query
def audit_domains(spark, sf):
    return maintenance.audit_domains(_flawed(spark, sf))


@query
def primary_email(spark, sf):
    profiles = spark.sql(
        """select c_custkey,
             case c_custkey % 4 when 0 then 'Public' || cast(c_custkey as string) || '@X.io' when 1 then '' end as email,
             array(named_struct('email', 'first@x.io', 'primary', false, 'verified', true),
                   named_struct('email', case when c_custkey % 6 = 0 then '' else 'Second@x.io' end,
                                'primary', true, 'verified', c_custkey % 5 <> 0),
                   named_struct('email', 'third@x.io', 'primary', true, 'verified', c_custkey % 7 = 0)) as emails
           from {customer}""",
        customer=V.table(spark, sf, "customer"),
    )
    return maintenance.with_primary_email(profiles).select("c_custkey", "email")


@query
def resolve_accounts(spark, sf):
    """Two profiles per supplier, in order of seq; matched by id, by address or not at all."""
    profiles = spark.sql(
        """select case s_suppkey % 4 when 0 then s_suppkey * 3 else 1000000 + s_suppkey * 2 + d end as github_id,
             'name' || cast(s_suppkey as string) || '-' || cast(d as string) as username,
             case s_suppkey % 4 when 1 then 'C' || cast(s_suppkey as string) || '@X.io'
               else 's' || cast(s_suppkey as string) || '@y.io' end as email,
             case when (s_suppkey + d) % 2 = 0 then '' else s_name || '-' || cast(d as string) end as full_name,
             'http://a/' || cast(d as string) as avatar_url, s_suppkey * 2 + d as seq
           from {supplier} lateral view explode(array(0, 1)) t as d""",
        supplier=V.table(spark, sf, "supplier"),
    )
    resolved = maintenance.resolve_accounts(V.catalogue(spark, sf, "users_v"), profiles)
    return resolved.withColumn("user_id", F.when(F.col("action") != "create", F.col("user_id")))


@query
def merge_accounts(spark, sf):
    """The users table after profiles of which every fifth supplier's have no usable address."""
    profiles = spark.sql(
        """select case s_suppkey % 4 when 0 then s_suppkey * 3 else 1000000 + s_suppkey end as github_id,
             'name' || cast(s_suppkey as string) as username, if(s_suppkey % 2 = 0, '', cast(null as string)) as email,
             array(named_struct('email', case when s_suppkey % 4 = 1 then 'C' || cast(s_suppkey as string) || '@X.io'
               else 's' || cast(s_suppkey as string) || '@y.io' end, 'primary', true, 'verified', s_suppkey % 5 <> 0)) as emails,
             s_name as full_name, 'http://a' as avatar_url, s_suppkey as seq from {supplier}""",
        supplier=V.table(spark, sf, "supplier"),
    )
    users = V.catalogue(spark, sf, "users_v")
    resolved = maintenance.resolve_accounts(users, maintenance.with_primary_email(profiles))
    merged = maintenance.merge_accounts(users, resolved, F.lit("2030-01-01").cast("timestamp"))
    known = users.select(F.col("id").alias("_id"))
    return merged.join(known, F.col("id") == F.col("_id"), "left").select(
        F.coalesce("_id", F.lit("new")).alias("id"), "email", "full_name", "github_id", "github_username", "auth_provider"
    )


@query
def register_accounts(spark, sf):
    """Sign-ups with an address by order customer: known for even keys."""
    requests = spark.sql(
        """select o_orderkey as seq, case when o_custkey % 2 = 0 then 'C' || cast(o_custkey as string) || '@X.io'
             else 'New' || cast(o_custkey as string) || '@z.io' end as email, 'Someone' as full_name from {orders}""",
        orders=V.table(spark, sf, "orders"),
    )
    return maintenance.register_accounts(V.catalogue(spark, sf, "users_v"), requests).select("seq", "email", "outcome")
