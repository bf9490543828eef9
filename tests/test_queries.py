"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = [
    "pair_evidence", "top_k_per_source", "order_cleanse_stats", "normalise_stats", "validation_stats", "snapshot_digest",
    "find_by_source", "commercial_truth", "price_quote", "commercial_topk", "affinity_coverage", "search_topk", "intent_decision",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_detail_holds_texts_and_variants(spark, con):
    test_query_matches_sql(spark, con, "product_detail_full")
    rows = con.execute(f"SELECT * FROM ({entry.oracle_sql()['product_detail_full']})").fetchdf()
    assert (rows["variants"].fillna("").str.count("\n") >= 1).any() and (rows["attributes"].fillna("") != "").any()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_detail_without_prices_reads_no_rules(spark, con, monkeypatch):
    from wicker.plans import views as V

    def refuse(*_):
        raise AssertionError("price rules are read")

    monkeypatch.setattr(V, "price_rules", refuse)
    test_query_matches_sql(spark, con, "product_detail_full")
