import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from stageloom.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

# One or two of each family; check.py runs them all.
SAMPLE = """aggregate_basic apply_mapping switch_route surrogate_key_continue lookup_chain merge_upsert scd2
change_capture window_rank chunk_groups collapse_runs pivot_stage group_members fn_clean_text fn_extract_block
check_reconcile complexity_score priority_waves similar_pairs similarity_clusters order_similarity cosine_top1
topological_levels structure_diff session_summary plan_cost stream_upsert upsert_delta upsert_compact incremental_read
window_offsets window_frames window_range custom_groups content_hash bag_fingerprint export_flat job_xml_files job_older_xml
join_full stream_sessions""".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["nation", "order_year", "n_lines", "revenue", "max_qty", "avg_qty"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
