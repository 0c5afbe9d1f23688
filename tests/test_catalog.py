"""The registry, and a sample of queries against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from onledger import catalog  # noqa: E402
from onledger.bindings import BASE  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("agg_07_exact_256_bit_sum", "agg_10_dense_histogram", "dec_08_swap_amounts", "flt_02_token_screen", "jon_08_asof_backward",
          "jon_14_fifo_match", "pip_06_attribute_flows", "pip_10_wallet_profile", "pip_22_decide", "pip_29_replay_paths",
          "pip_40_redact_documents", "snk_05_idempotent_append", "str_04_sliding_members", "win_09_trailing_counts")


def test_registry():
    queries, checks = contract.queries(), contract.oracle_sql()
    assert set(checks) <= set(queries) and set(SAMPLE) <= set(checks) and contract.FLAGSHIP in queries
    core = set(catalog.load())
    assert core <= set(queries) and core - set(checks) == {"snk_04_file_manifest"}


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, name):
    from parity import compare

    con = duckdb.connect()
    for base in BASE:
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{SMALL}/{base}.parquet'")
    df = contract.queries()[name](spark, SMALL)
    cur = con.execute(contract.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall()) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
