import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from lintmill.functions.repo_ref import parse_repo_ref
from lintmill.operators import maintenance as M
from lintmill.operators import settings as S


def parse(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rows = df.select("i", parse_repo_ref(F.col("v")).alias("r")).orderBy("i").collect()
    return [tuple(r.r) for r in rows]


def plainly(source):
    """The rules of a reference, one after the other."""
    text = source.strip()
    if not text:
        return None, None, "empty"
    if re.search("[\n\r\0;|&$`<>\"'\\\\]", text):
        return None, None, "forbidden_character"
    if "github.com" in text.lower():
        url = text if text.startswith(("http://", "https://")) else "https://" + text
        split = urlsplit(url)
        if split.netloc.lower() not in ("github.com", "www.github.com"):
            return None, None, "unsupported_host"
        parts = [p for p in split.path.split("/") if p]
    else:
        parts = text.strip("/").split("/")
    if len(parts) != 2 or not all(parts):
        return None, None, "not_owner_and_name"
    owner, name = parts[0], parts[1].removesuffix(".git")
    if not re.fullmatch(r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,37}[a-zA-Z0-9])?", owner):
        return None, None, "invalid_owner"
    if not re.fullmatch(r"[a-zA-Z0-9._-]+", name):
        return None, None, "invalid_name"
    return owner, name, None


def test_references(spark):
    heads = ["", "https://github.com/", "HTTPS://github.com/", "http://www.GitHub.com//", "github.com/", "github.com:80/",
             "https://u@github.com/", "https://notgithub.com/", "/", "https://github.com?", "ftp://github.com/"]
    owners = ["own", "-own", "own-", "o" * 39, "o" * 40, "ö", "a_b", ""]
    names = ["repo", "repo.git", "repo.git.git", ".git", "re po", "r/x", "r?x=1#y", "r\tx", "r;x", "r\\x", "r/", "_.-"]
    values = [f"{h}{o}/{n}" for h in heads for o in owners for n in names] + ["  own/repo\n", "github.com", " ", "own", "\xa0o/n"]
    got = parse(spark, values)
    wanted = [plainly(v) for v in values]
    assert [(v, g, w) for v, g, w in zip(values, got, wanted, strict=True) if g != w] == []
    assert parse(spark, ["https://github.com/a[/b", "https://[github.com/a/b"])[1][2] == "unsupported_host"


def test_registration(spark):
    requests = spark.createDataFrame(
        [("u", 2, "own/new", None), ("u", 1, "github.com/own/new.git", "b"), ("v", 3, "own/old", None), ("u", 4, "own/old", None),
         ("u", 5, "own/Old", None), ("u", 6, "ab", None), ("u", 7, "own/x", "b" * 256), ("u", 8, "x" * 513, None)],
        "user_id string, seq int, url string, branch string")
    known = spark.createDataFrame([("u", "own", "old")], "user_id string, owner string, name string")
    decided = M.register_repositories(requests, known)
    rows = {r.seq: (r.outcome, r.error) for r in decided.collect()}
    assert rows == {1: ("registered", None), 2: ("duplicate", None), 3: ("registered", None), 4: ("duplicate", None),
                    5: ("registered", None), 6: ("invalid", "invalid_length"), 7: ("invalid", "invalid_length"),
                    8: ("invalid", "invalid_length")}
    created = M.new_repositories(decided, F.current_timestamp()).collect()
    assert sorted(r.url for r in created) == ["https://github.com/own/Old", "https://github.com/own/new", "https://github.com/own/old"]
    assert {r.status for r in created} == {"cloning"} and len({r.id for r in created}) == 3


def test_settings(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    own = spark.createDataFrame([("a", "", "m", None, ".PY", 0)],
        "user_id string, ollama_base_url string, ollama_model string, ignored_folders string, ignored_extensions string, max_file_size_bytes int")
    rows = {r.user_id: r for r in S.effective_settings(users, own).collect()}
    assert (rows["a"].ollama_base_url, rows["a"].ollama_model) == ("http://localhost:11434", "m")
    assert (rows["a"].max_file_size_bytes, rows["b"].ollama_model, rows["a"].ignored_extensions) == (1048576, "qwen2.5", ".PY")
    patches = spark.createDataFrame(
        [("a", 2, {"ollama_model": None}), ("a", 1, {"ollama_model": "n", "max_file_size_bytes": "2048"}), ("c", 1, {})],
        "user_id string, seq int, changes map<string,string>")
    rows = {r.user_id: r for r in S.patch_settings(own, patches).collect()}
    assert (rows["a"].ollama_model, rows["a"].max_file_size_bytes, rows["a"].ignored_extensions) == (None, 2048, ".PY")
    assert rows["c"].ollama_model is None and len(rows) == 2


def test_setting_checks(spark):
    values = [("ftp://x", None, None), ("HTTP://x", None, 1024), (" https://x", "m" * 128, 10485760), ("", None, 1023),
              (None, "m" * 129, None), ("http://" + "x" * 506, None, None), (None, None, 10485761)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)],
        "i int, ollama_base_url string, ollama_model string, max_file_size_bytes int")
    errors = [r.error for r in S.validate_settings(df).orderBy("i").collect()]
    assert errors == ["url_scheme", None, None, "size_out_of_range", "model_too_long", "url_too_long", "size_out_of_range"]


USERS = "id string, email string, full_name string, github_id long, github_username string, avatar_url string, auth_provider string"


def test_accounts(spark):
    users = spark.createDataFrame(
        [("1", "a@x", None, None, None, None, "local"), ("2", "b@x", "Bee", 7, "old", None, "github")], USERS)
    profiles = spark.createDataFrame(
        [(5, "ann", "A@x", "Ann", "pic", 1), (7, "bee", "new@x", "", "pic", 2), (8, "cid", "C@x", "", None, 3),
         (9, "cid2", "c@X", "Cid", None, 4), (7, "bee2", "newer@x", None, None, 5)],
        "github_id long, username string, email string, full_name string, avatar_url string, seq int")
    rows = {r.email: r for r in M.resolve_accounts(users, profiles).collect()}
    assert set(rows) == {"a@x", "newer@x", "c@x"}
    linked, updated, created = rows["a@x"], rows["newer@x"], rows["c@x"]
    assert (linked.action, linked.user_id, linked.full_name, linked.auth_provider) == ("link", "1", "Ann", "github")
    assert (updated.action, updated.user_id, updated.full_name, updated.github_username) == ("update", "2", "Bee", "bee2")
    assert (created.action, created.github_id, created.full_name) == ("create", 9, "Cid")


def test_primary_email(spark):
    entry = "struct<email:string,primary:boolean,verified:boolean>"
    df = spark.createDataFrame(
        [(0, "Pub@X", []), (1, "", [("a@x", True, False), ("B@x", True, True)]), (2, None, [("a@x", False, True)]),
         (3, None, [("", True, True), ("c@x", True, True)])], f"i int, email string, emails array<{entry}>")
    assert [r.email for r in M.with_primary_email(df).orderBy("i").collect()] == ["pub@x", "b@x", None, "c@x"]


def test_sign_ups(spark):
    users = spark.createDataFrame([("a@x",)], "email string")
    requests = spark.createDataFrame([(1, "A@X", "n"), (3, "b@x", "n"), (2, "B@x", "n")], "seq int, email string, full_name string")
    rows = {r.seq: r.outcome for r in M.register_accounts(users, requests).collect()}
    assert rows == {1: "duplicate_email", 2: "registered", 3: "duplicate_email"}


@pytest.fixture
def tables(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "users": frame([("u",), ("v",)], "id string"),
        "user_settings": frame([("u",), ("v",), ("w",)], "user_id string"),
        "repositories": frame([("p", "u"), ("q", "v"), ("q", "x")], "id string, user_id string"),
        "reviews": frame([("r", "p", "u"), ("s", "q", "v"), ("t", "q", "u")], "id string, repository_id string, user_id string"),
        "review_issues": frame([("r", "f"), ("s", "f"), ("t", "f"), ("z", "f"), ("z", "g")], "review_id string, file_path string"),
        "file_analysis_results": frame([("s", "f")], "review_id string, file_path string"),
    }


def test_cascade(spark, tables):
    def left(**deleted):
        gone = {k: spark.createDataFrame([(v,)], "id string") for k, v in deleted.items()}
        result = M.cascade_delete(tables, **gone)
        return {n: sorted(r[0] for r in df.collect()) for n, df in result.items()}

    assert left(reviews="r")["review_issues"] == ["s", "t", "z", "z"]
    after = left(repositories="q")
    assert after["reviews"] == ["r"] and after["file_analysis_results"] == [] and after["users"] == ["u", "v"]
    after = left(users="u")
    assert after == {"users": ["v"], "user_settings": ["v", "w"], "repositories": ["q", "q"], "reviews": ["s"],
                     "review_issues": ["s", "z", "z"], "file_analysis_results": ["s"]}


def test_audits(spark, tables):
    assert [(r.table_name, r.column_name, r.value, r.n_rows) for r in M.audit_unique(tables).collect()] == [("repositories", "id", "q", 2)]
    orphans = sorted((r.table_name, r.column_name, r.value, r.n_rows) for r in M.audit_orphans(tables).collect())
    assert orphans == [("repositories", "user_id", "x", 1), ("review_issues", "review_id", "z", 2), ("user_settings", "user_id", "w", 1)]
    issues = spark.createDataFrame(
        [("r", "x" * 1025, 1.5, "odd", "bug"), (None, "f", 1.0, "low", "dead_code"), ("r", "f", None, "low", "bug")],
        "review_id string, file_path string, confidence double, severity string, category string")
    found = {(r.kind, r.column_name): r.n_rows for r in M.audit_domains({"review_issues": issues}).collect()}
    assert found == {("null", "review_id"): 1, ("null", "confidence"): 1, ("too_long", "file_path"): 1,
                     ("unknown_value", "severity"): 1, ("out_of_range", "confidence"): 1}
    fine, odd = M.quarantine_issues(issues)
    assert (fine.count(), odd.count()) == (1, 2)


def test_no_merge_breaks_a_unique_key(spark):
    """Random batches: whatever they ask for, no two accounts end with one address or link."""
    rnd = random.Random(4)
    schema = ("id string, email string, hashed_password string, full_name string, github_id long, github_username string, avatar_url string, "
              "auth_provider string, is_active boolean, created_at timestamp, updated_at timestamp")
    for _ in range(3):
        users = [(f"u{i}", f"a{i}@x.io", None, None, i if i % 2 else None, None, None, "local", True, None, None) for i in range(12)]
        asked = [(rnd.choice([1, 3, 5, 7, 9, 11, *range(20, 30)]), "n", f"{rnd.choice('aA')}{rnd.randrange(16)}@x.io", None, None, seq) for seq in range(40)]
        profiles = spark.createDataFrame(asked, "github_id long, username string, email string, full_name string, avatar_url string, seq int")
        frame = spark.createDataFrame(users, schema)
        resolved = M.resolve_accounts(frame, profiles).cache()
        merged = M.merge_accounts(frame, resolved, F.lit("2024-01-01").cast("timestamp"))
        lowered = merged.withColumn("email", F.lower("email"))
        assert M.audit_unique({"users": lowered}).collect() == []
        actions = {r.action for r in resolved.collect()}
        assert "conflict" in actions and {"update", "create"} <= actions
        resolved.unpersist()


def test_a_taken_address_is_a_conflict(spark):
    schema = "id string, email string, github_id long, full_name string, auth_provider string"
    users = spark.createDataFrame([("u1", "a@x.io", 1, None, "github"), ("u2", "b@x.io", 2, None, "github"), ("u3", "c@x.io", 3, None, "local")], schema)
    profiles = spark.createDataFrame(
        [(1, "n", "b@x.io", None, None, 1), (2, "n", "new@x.io", None, None, 2), (3, "n", "new@x.io", None, None, 3), (9, "n", "new@x.io", None, None, 4), (8, "n", "a@x.io", None, None, 5)],
        "github_id long, username string, email string, full_name string, avatar_url string, seq int")
    found = {r.github_id: (r.action, r.user_id) for r in M.resolve_accounts(users, profiles).collect()}
    # u1 may not have u2's address, which u2 itself gives up only in this batch; u3 asks last for the new one.
    assert found[1] == ("conflict", None) and found[2] == ("conflict", None) and found[3] == ("update", "u3")
    assert found[9] == ("conflict", None) and found[8] == ("link", "u1")


def test_ids_are_numbered_where_the_rows_are_dealt(spark):
    """One shuffle, of the rows themselves; fractions of either zero stay apart, as their texts are."""
    row = ("r", "a.py", 1, None, "bug", "low", 0.5, "x", "t", "e", "s")
    rows = [row, row, row[:6] + (0.0,) + row[7:], row[:6] + (-0.0,) + row[7:], (None,) + row[1:]]
    columns = """review_id string, file_path string, line_start int, line_end int, category string, severity string,
        confidence double, rule_id string, title string, explanation string, suggestion string"""
    made = M.identified(spark.createDataFrame(rows, columns), "review_issues")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "to_json" not in plan[plan.index("Exchange") :].lower() and "sha2" not in plan[plan.index("Exchange") :]
    ids = [r.id for r in made.collect()]
    assert len(set(ids)) == 5 and all(len(i) == 64 for i in ids)
