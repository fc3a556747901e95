from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from sitemill.sources.adapters import TABLES
from tools.compare import rows_of

# every query runs against its SQL with tools/compare.py; these cover each area quickly
SAMPLE = [
    "page_prepare_dedup", "page_preferred_address", "candidate_identity_merge", "redirect_closure", "category_rollup", "product_stock_state", "related_products", "listing_members",
    "calendar_month_groups", "local_instants", "cdc_decisions", "relation_issues", "media_inventory", "file_states", "cart_quote", "payment_event_verdicts", "order_status_replay", "page_titles",
    "product_pages", "product_images", "listing_cards", "page_menus", "page_trails", "calendar_pages", "gallery_pages", "made_bodies", "nested_entity_issues", "folder_totals", "metric_summary", "key_forms", "money_forms", "contact_forms", "digest_forms",
]


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET timezone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([item[0] for item in cursor.description], cursor.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
