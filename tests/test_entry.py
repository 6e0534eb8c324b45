"""End to end: the driver contract on the smallest scale factor."""

import re

import pytest

from helpers import SMALL

import __spark_entry__ as E
from finch.plans import all_oracles, all_queries

# Rows of each table that a query's own rows are counted against, where that holds.
ONE_ROW_EACH = {"doc_clean": "documents", "doc_clean_cased": "documents", "phrase_removal": "documents", "drop_header_lines": "documents",
                "quote_block": "documents", "scan_text_dir": "documents", "scan_text_dir_flat": "documents", "txn_batches": "lineitem",
                "txn_clean_description": "lineitem", "txn_key_string": "lineitem", "scan_csv": "lineitem", "date_coerce": "lineitem",
                "page_main_block": "pages", "page_text_exact": "pages", "page_line_trim": "pages", "url_domain": "pages",
                "scan_sitemap_xml": "pages", "prompt_rag": "customer", "prompt_notebook": "customer", "profile_validate": "customer",
                "vector_cosine": "embeddings", "json_field": "events"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["item_id", "doc_id", "pos", "rank", "sim", "text"]


def test_every_query_has_an_oracle():
    # power iteration has no SQL; tests/test_trained.py compares it with dense linear algebra
    assert set(all_queries()) - {"embed_trained"} == set(all_oracles())
    assert set(all_queries()) <= set(E.queries()) and set(all_oracles()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_runs_with_stable_schema(spark, name):
    df = all_queries()[name](spark, SMALL)
    cols = df.columns
    n = df.count()
    assert df.columns == cols
    if name in ONE_ROW_EACH:
        assert n == spark.read.parquet(f"{SMALL}/{ONE_ROW_EACH[name]}.parquet").count()
    else:
        assert n > 0


def test_native_operators_have_no_python_udf(spark):
    for name in ["chunk_sentences", "txn_clean_description", "category_canonical", "page_text_native", "rag_topk"]:
        plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BatchEvalPython|ArrowEvalPython", plan), name
