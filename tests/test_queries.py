import os

import pytest

from seqlake.plans import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["stats_lengths", "comp_nucleotide", "region_extract", "strand_compose", "record_layout", "nonuniform_reason", "findings_by_code", "index_compare", "index_compare_fields", "findings_every_rule", "records_by_severity", "invalid_symbols", "positional_read", "findings_places", "fault_places", "index_damage", "index_compare_sides", "index_counts", "alphabet_by_file", "duplicates_in_budget"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "labels", "part"):
        path = f"{DATA}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())
