"""Batches with null and malformed input: a reason for each row, none lost, no failed job."""

import pytest
from pyspark.sql import functions as F

from lintmill.operators import maintenance as M
from lintmill.operators import settings as S
from lintmill.schemas import TABLES
from lintmill.sources import corpus

PROFILE = "github_id long, username string, email string, full_name string, avatar_url string, seq int"


@pytest.fixture
def at(spark):
    return F.lit("2030-01-01").cast("timestamp")


@pytest.fixture
def users(spark, at):
    rows = [("u1", "a@x.io", "h", "Ann", 7, "ann", None, "github", True), ("u2", "b@x.io", "h", None, None, None, None, "local", True)]
    names = "id string, email string, hashed_password string, full_name string, github_id long, github_username string, avatar_url string, auth_provider string, is_active boolean"
    return spark.createDataFrame(rows, names).withColumns({"created_at": at, "updated_at": F.lit(None).cast("timestamp")}).select(*TABLES["users"].fieldNames())


def test_profiles_without_an_address_touch_nothing(spark, users, at):
    rows = [(7, "ann", None, "X", None, 1), (8, "new", "", None, None, 2), (9, "n2", None, None, None, 3), (7, "ann2", "A2@x.io", "", None, 0), (10, "bob", "B@x.io", "Bob", "p", 4), (11, "cy", "c@x.io", "Cy", None, 5)]
    resolved = M.resolve_accounts(users, spark.createDataFrame(rows, PROFILE))
    assert sorted((r.action, r.user_id if r.action != "create" else None, r.email) for r in resolved.collect()) == [
        ("create", None, "c@x.io"), ("link", "u2", "b@x.io"), ("rejected", None, None), ("rejected", None, None), ("rejected", None, None), ("update", "u1", "A2@x.io"),
    ]
    after = {r.email: r for r in M.merge_accounts(users, resolved, at).collect()}
    assert set(after) == {"A2@x.io", "b@x.io", "c@x.io"}
    assert after["A2@x.io"].full_name == "Ann" and after["b@x.io"].hashed_password == "h" and after["b@x.io"].github_id == 10
    new = after["c@x.io"]
    assert new.id and new.hashed_password is None and new.auth_provider == "github" and new.is_active and new.created_at.year == 2030


def test_sign_ups(spark, users, at):
    rows = [(1, "A@x.io", "h", None), (2, None, "h", None), (3, "", "h", None), (4, "n@x.io", "h1", "N"), (5, "N@x.io", "h2", None)]
    decided = M.register_accounts(users, spark.createDataFrame(rows, "seq int, email string, hashed_password string, full_name string"))
    assert {r.seq: r.outcome for r in decided.collect()} == {1: "duplicate_email", 2: "rejected", 3: "rejected", 4: "registered", 5: "duplicate_email"}
    (new,) = M.new_users(decided, at).collect()
    assert (new.email, new.hashed_password, new.auth_provider) == ("n@x.io", "h1", "local")


def test_requests_without_a_reference(spark):
    rows = [("u", 1, None, None), ("u", 2, "", None), ("u", 3, "o/n", None), (None, 4, None, None)]
    requests = spark.createDataFrame(rows, "user_id string, seq int, url string, branch string")
    known = spark.createDataFrame([], "user_id string, owner string, name string")
    got = {r.seq: (r.outcome, r.error) for r in M.register_repositories(requests, known).collect()}
    assert len(got) == 4 and got[1] == got[4] == ("invalid", "empty") and got[3][0] == "registered" and got[2][0] == "invalid"


def test_bad_patches_are_refused_whole(spark, at):
    rows = [("u1", 1, {"max_file_size_bytes": "10k", "ollama_model": "m"}), ("u1", 2, {"ollama_model": "kept"}), ("u2", 1, {"max_file_size_bytes": "12"}), ("u3", 1, {"ollama_base_url": "ftp://x"}), ("u4", 1, {"max_file_size_bytes": "5000"}), ("u5", 1, None)]
    patches = spark.createDataFrame(rows, "user_id string, seq int, changes map<string,string>")
    errors = {(r.user_id, r.seq): r.error for r in S.check_patches(patches).collect()}
    assert errors == {("u1", 1): "size_not_a_number", ("u1", 2): None, ("u2", 1): "size_out_of_range", ("u3", 1): "url_scheme", ("u4", 1): None, ("u5", 1): None}
    old = spark.createDataFrame([("u1", None, "old", None, None, 9000)], "user_id string, ollama_base_url string, ollama_model string, ignored_folders string, ignored_extensions string, max_file_size_bytes int")
    old = old.withColumns({"created_at": F.lit("2020-01-01").cast("timestamp"), "updated_at": F.lit("2020-01-01").cast("timestamp")})
    after = {r.user_id: r for r in S.patch_settings(old, patches, at).collect()}
    assert (after["u1"].ollama_model, after["u1"].max_file_size_bytes, after["u1"].created_at.year, after["u1"].updated_at.year) == ("kept", 9000, 2020, 2030)
    assert after["u4"].max_file_size_bytes == 5000 and after["u4"].created_at.year == 2030 and set(after) == {"u1", "u4", "u5"}


def test_files_of_users_without_settings_have_the_defaults(spark):
    files = spark.createDataFrame([("u1", "a.py", 10), ("u2", "a.py", 10), (None, "a.py", 10), ("u2", "node_modules/a.py", 10)], "user_id string, file_path string, size_bytes long")
    limits = spark.createDataFrame([("u1", "x", ".py", 100)], "user_id string, ignored_folders string, ignored_extensions string, max_file_size_bytes int")
    assert sorted(str(r.user_id) for r in corpus.analyzable(files, limits).collect()) == ["None", "u2"]


def test_the_scan_follows_each_owners_settings(spark, tmp_path):
    for path in ("a/x.PY", "a/lib/y.py", "a/pic.png", "b/x.PY", "b/lib/y.py", "c/lib/y.py", "c/.git/objects/ab"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    owners = spark.createDataFrame([("a", "u1"), ("b", "u2")], "repository_path string, user_id string")
    limits = spark.createDataFrame([("u1", "lib", "", 100), ("u2", "", ".py", 100)], "user_id string, ignored_folders string, ignored_extensions string, max_file_size_bytes int")
    files = corpus.read_corpus(spark, str(tmp_path), repository_depth=1, owners=owners, settings=limits)
    assert sorted((r.review_id, r.file_path) for r in files.collect()) == [("a", "x.PY"), ("c", "lib/y.py")]
    listed = corpus.list_corpus(spark, str(tmp_path), 1, corpus.source_glob())
    assert sorted(r.file_path for r in listed.collect()) == ["lib/y.py", "lib/y.py", "lib/y.py", "x.PY", "x.PY"]
