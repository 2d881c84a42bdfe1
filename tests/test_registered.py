import os

import pytest

import __spark_entry__
from conformance.check import compare, oracle_connection
from conformance.oracles import ORACLES
from conformance.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

SAMPLE = ["scan_order", "corpus_scan", "patch_settings", "rules_cpp", "long_functions_js", "py_all_rules", "dup_blocks", "review_summary",
          "static_review_issues", "static_review_summary", "search_text", "search_wildcard_index", "search_sort_issues_up", "list_reviews",
          "register_repositories", "ai_prepared_files", "audit_child_ids", "search_page", "ai_snippets", "ai_review_summary", "report_bundle", "cascade_delete", "resolve_accounts", "merge_accounts", "report_json"]


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_its_oracle(spark, connection, name):
    ok, detail = compare(spark, connection, SF, name)
    assert ok, detail


def test_contract(spark):
    assert set(ORACLES) == set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
