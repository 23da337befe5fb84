"""A few registered queries against their SQL twins on the smallest test tables, where those are there."""

import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def twins():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["seq_summary", "base_composition", "nan_interp", "pds_chunked", "bounded_segment", "region_metrics", "motif_annotation", "consensus", "fasta_parse", "di_summary", "export_csv", "export_gff", "sequence_lookup", "summary_file"])
def test_query_equals_sql(spark, twins, name):
    import __spark_entry__ as entry

    got, want = entry.queries()[name](spark, DATA), twins.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and [c for c, _ in got.dtypes]
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    b = sorted((tuple(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert a == b


def test_every_sequence_query_has_a_twin():
    from seqtrough.plans.queries import QUERIES, SQL

    assert set(QUERIES) == set(SQL) and len(QUERIES) > 40
