"""Table schemas, value domains and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _table(*columns: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType(
        [T.StructField(c[0], c[1], c[2] if len(c) > 2 else False) for c in columns]
    )


# ---- fixed values: domains, penalties, languages, defaults ------------------

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

# Report order, and points taken off a file's score.
SEVERITY_PENALTY = {"critical": 15.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.5}
SEVERITIES = list(SEVERITY_PENALTY)
UNKNOWN_SEVERITY_PENALTY = 1.0

REVIEW_STATUSES = ["pending", "running", "completed", "failed"]
REVIEW_TYPES = ["static", "ai", "hybrid"]
REPOSITORY_STATUSES = ["pending", "cloning", "ready", "failed"]

LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cs": "csharp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".h": "cpp",
    ".c": "cpp",
}

DEFAULT_SETTINGS = {
    "ollama_base_url": "http://localhost:11434",
    "ollama_model": "qwen2.5",
    "ollama_timeout_seconds": 120,
    "ai_max_files": 10,
    "ai_max_chars_per_file": 4000,
    "ai_temperature": 0.2,
    "max_file_size_bytes": 1_048_576,
    "ignored_folders": "node_modules,.git,__pycache__,dist,build,.venv,venv",
    "ignored_extensions": ".min.js,.map,.lock,.png,.jpg,.jpeg,.gif,.svg,.ico,.woff,.woff2",
}
MIN_FILE_SIZE_SETTING, MAX_FILE_SIZE_SETTING = 1024, 10_485_760

# ---- catalogue --------------------------------------------------------------

USERS = _table(
    ("id", _S),
    ("email", _S),
    ("hashed_password", _S, True),
    ("full_name", _S, True),
    ("github_id", _L, True),
    ("github_username", _S, True),
    ("avatar_url", _S, True),
    ("auth_provider", _S),
    ("is_active", _B),
    ("created_at", _TS),
    ("updated_at", _TS),
)
REPOSITORIES = _table(
    ("id", _S),
    ("user_id", _S),
    ("url", _S),
    ("owner", _S),
    ("name", _S),
    ("default_branch", _S, True),
    ("local_path", _S, True),
    ("status", _S),
    ("error_message", _S, True),
    ("cloned_at", _TS, True),
    ("created_at", _TS),
    ("updated_at", _TS),
)
REVIEWS = _table(
    ("id", _S),
    ("repository_id", _S),
    ("user_id", _S),
    ("status", _S),
    ("review_type", _S),
    ("ai_model", _S, True),
    ("report_markdown", _S, True),
    ("files_analyzed", _I),
    ("issues_count", _I),
    ("overall_score", _D),
    ("summary", _S, True),
    ("error_message", _S, True),
    ("started_at", _TS, True),
    ("completed_at", _TS, True),
    ("created_at", _TS),
)
ISSUES = _table(
    ("review_id", _S),
    ("file_path", _S),
    ("line_start", _I),
    ("line_end", _I, True),
    ("category", _S),
    ("severity", _S),
    ("confidence", _D),
    ("rule_id", _S),
    ("title", _S),
    ("explanation", _S),
    ("suggestion", _S),
    ("id", _S, True),
)
FILE_RESULTS = _table(
    ("review_id", _S),
    ("file_path", _S),
    ("language", _S),
    ("line_count", _I),
    ("issues_count", _I),
    ("file_score", _D),
    ("id", _S, True),
)
USER_SETTINGS = _table(
    ("user_id", _S),
    ("ollama_base_url", _S, True),
    ("ollama_model", _S, True),
    ("ignored_folders", _S, True),
    ("ignored_extensions", _S, True),
    ("max_file_size_bytes", _I, True),
    ("created_at", _TS),
    ("updated_at", _TS),
    ("id", _S, True),
)
FILES = _table(
    ("review_id", _S),
    ("file_path", _S),
    ("language", _S),
    ("size_bytes", _L),
    ("content", _S),
)
AI_RESPONSES = _table(("review_id", _S), ("raw", _S))

TABLES = {
    "users": USERS,
    "repositories": REPOSITORIES,
    "reviews": REVIEWS,
    "review_issues": ISSUES,
    "file_analysis_results": FILE_RESULTS,
    "user_settings": USER_SETTINGS,
}

# What tells the rows of a table apart; equal rows are numbered (see ``maintenance.identified``).
IDENTITY = {
    "review_issues": [c for c in ISSUES.fieldNames() if c != "id"],
    "file_analysis_results": ["review_id", "file_path"],
    "user_settings": ["user_id"],
}

# Values a row written before a column existed is read with.
COLUMN_DEFAULTS = {
    "users": {"auth_provider": "local", "is_active": True},
    "repositories": {"status": "pending"},
    "reviews": {
        "review_type": "static",
        "files_analyzed": 0,
        "issues_count": 0,
        "overall_score": 0.0,
    },
    "file_analysis_results": {"issues_count": 0, "file_score": 100.0},
}

# Longest value each text column may hold.
MAX_LENGTHS = {
    "users": {
        "email": 255,
        "hashed_password": 255,
        "full_name": 255,
        "github_username": 255,
        "avatar_url": 512,
        "auth_provider": 32,
    },
    "repositories": {
        "url": 512,
        "owner": 255,
        "name": 255,
        "default_branch": 255,
        "local_path": 1024,
        "status": 32,
    },
    "reviews": {"status": 32, "review_type": 32, "ai_model": 128},
    "review_issues": {
        "file_path": 1024,
        "category": 64,
        "severity": 32,
        "rule_id": 128,
        "title": 255,
    },
    "file_analysis_results": {"file_path": 1024, "language": 64},
    "user_settings": {"ollama_base_url": 512, "ollama_model": 128},
}

VALUE_DOMAINS = {
    "repositories": {"status": REPOSITORY_STATUSES},
    "reviews": {"status": REVIEW_STATUSES, "review_type": REVIEW_TYPES},
    "review_issues": {"category": CATEGORIES, "severity": SEVERITIES},
}

ISSUE_COLUMNS = [c for c in ISSUES.fieldNames() if c != "id"]
