"""Registered queries against their SQL. ALL_QUERIES=1 runs every one (about ten minutes)."""

import os

import pytest

import __spark_entry__ as entries
from tests.compare import compare, connect

QUICK = (
    "html1_paragraphs fn6_resolve_links lnk1_page_links wf1_word_frequency grf1_page_table grf2_reachable_succession "
    "pr1_rank_step pr2_pagerank_succession idx1_build_index srch1_search_boosted srch5_batch_search srch2_query_space_search "
    "srch3_case_sensitive_search cat2_search_with_reviews val1_product_requests id2_lowest_free_ids ord3_stock_allocation "
    "ord5_stock_after chk1_missing_values st2_in_degree_stream st4_review_stream"
).split()
NAMES = sorted(entries.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, entries.queries()[name], entries.oracle_sql()[name]) is None


def test_every_query_has_checking_sql():
    own = {q for q in entries.queries() if not q.startswith("op") and q != "pipeline"}
    assert own == {q for q in entries.oracle_sql() if not q.startswith("op") and q != "pipeline"}


def test_entry_is_runnable(spark):
    assert entries.entry(spark).columns
