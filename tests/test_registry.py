import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["a4_upsert_edges", "b9_chunk_fixed", "c5_search_names", "d17_resolve_flow_ends", "g4_list_tasks", "g20_flow_layers", "h8_collapse_single_branch_gateways", "i2_match_role", "j5_restrict_inputs", "k5_flow_document", "m2_emit_on_change"])
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toArrow(), db.sql(entry.oracle_sql()[name]).to_arrow_table()
    rows = lambda t: sorted(repr(r) for r in zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)]))
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)
