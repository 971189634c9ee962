"""Every registered query against its SQL on the smallest tables."""
import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools_check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 4 and "mask_fraction_valid" in df.columns


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


#: Queries that no SQL states; they have tests against restatements.  A query outside this list needs SQL.
WITHOUT_SQL = set("""assignment_quality band_keep_excess era_agreement era_segmentation extract_lines fine_line_census latest_era_frames
    peak_census quiet_era_floor rational_thresholds spearman_bootstrap tone_injection unit_event_assignment
    op1_quality_fm op2_vector_packing op6_lattice_likelihood op7_block_labeller pipeline""".split())


def test_every_other_query_has_sql():
    assert set(queries()) - set(oracle_sql()) <= WITHOUT_SQL
