"""Registered queries against their SQL on the smallest given tables."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages events conversations labels".split()
# one query per group of operators; check_queries.py runs all of them
CHECKED = [
    "canonicalize_urls", "extract_links", "extract_text", "extract_rich_text", "recipe_lines", "score_content",
    "junk_gate", "length_gate", "curation_funnel", "run_stats", "render_chat_phi", "refilter_dataset", "refilter_written", "to_readable", "readable_dump",
    "curate_code", "chunk_code", "crawl_frontier", "crawl_frontier_same_site", "domain_cap", "discovery_stats", "crawl_stop_after",
    "extract_endpoints", "endpoint_files", "scan_code", "binary_pages", "quarantine", "top_fifth", "request_gap_audit", "stream_stats", "stream_health",
]


@pytest.fixture(scope="module")
def engine():
    if not os.path.exists(FOLDER):
        pytest.skip("no given tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if isinstance(value, datetime.datetime) else value


def test_every_query_has_a_check():
    own = {name for name in entry_module.queries() if name != "pipeline" and not name.startswith("op")} | {"overall"}
    assert own == {name for name in entry_module.oracle_sql() if not name.startswith("op")}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, engine, name):
    df = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = engine.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no given tables here")
    assert entry_module.entry(spark).count() > 0
