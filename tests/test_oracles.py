"""Registered queries against their checking SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, canon, close

NAMES = ["rolling_form_20", "scheduled_order_form", "rating_fold", "box_ratio_form", "market_features", "payload_archive_flatten", "fuzzy_event_match",
         "nearest_event_match", "market_constraint_suite", "season_folds", "status_snapshot_states", "impact_features", "expected_starter_features",
         "report_text_rows", "canonical_schedule", "schedule_revision_log", "three_way_scores", "bootstrap_relative_weeks", "ledger_monitor", "stream_missed_alerts"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = queries()[name](spark, sf)
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = canon(cols, cur.fetchall())
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(cols) == sorted(df.columns) and len(got) == len(want) and got
    assert all(all(close(a, b) for a, b in zip(x, y)) for x, y in zip(got, want) if x != y)
