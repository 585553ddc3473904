"""Physical plans: what must reach the scan, and what must not be there."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from cardmill.operators import search, vectors
from cardmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
READ = pytest.mark.skipif(not __import__("os").path.exists(FOLDER), reason="no test tables")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@READ
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_no_product_of_tables(spark, name):
    p = plan(catalogue.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@READ
def test_filters_and_columns_reach_the_scan(spark):
    t = catalogue.Tables(spark, FOLDER)
    p = plan(search.browse(t.cards, t.files, {"format": "Policy"}, evidence=True))
    assert "EqualTo(format,Policy)" in p and "EqualTo(is_evidence,1)" in p
    assert "body" not in p and "outline" not in p


@READ
def test_weights_shuffle_rows_once(spark):
    t = catalogue.Tables(spark, FOLDER)
    p = plan(vectors.tfidf(vectors.texts(t.cards, t.files).select("card_id", "text")))
    assert "Window" in p and p.count("REPARTITION_BY_COL") >= 1


@READ
def test_every_query_has_sql_or_is_known_to_have_none():
    none = {"highlighted_tags", "clean_text", "lsa_svd", "p6_survivors", "p7_found", "p7_spellings", "p8_leaks", "p9_mix", "p9_shares", "p10_shares"}
    assert set(entry.queries()) - set(entry.oracle_sql()) <= none
    assert set(entry.oracle_sql()) <= set(entry.queries())
