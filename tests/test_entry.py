import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.plans.oracles import oracles

DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"forest_scores"}


def test_names():
    assert set(oracles()) == set(QUERIES) - ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["candidates", "feat_fast_forward", "eval_ranked_budgets", "register_state", "ring_evidence", "decision_summary", "replay_two_passes", "eval_heldout_budgets", "ranker_scores", "chain_verify", "registry_simulated"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    made = entry.queries()[name](spark, DIR)
    cols = sorted(made.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, made.select(*cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0
