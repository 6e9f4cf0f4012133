"""Registered queries against their SQL. ``check.py`` runs all of them; here one or two per group."""

import duckdb
import pytest
from common import SF

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

PICKED = ["a18_normalize_flows", "b14_transition_entropy", "b12_destination_concentration", "c06_flow_metrics", "d17_device_index", "e14_lookalike",
          "e24_alert_policy", "f02_roc_auc", "f08_select_threshold", "g07_stability", "h06_privacy_columns", "i03_sequence_features",
          "j06_sample_by_source", "l05_sessions", "flagship_scored_windows"]


@pytest.mark.parametrize("name", PICKED)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 250
