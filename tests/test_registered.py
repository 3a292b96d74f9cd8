"""Registered queries against DuckDB, and rules every plan must keep."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
QUERIES, CHECKS = queries(), oracle_sql()

# A sample of every family; CHATLENS_ALL=1 compares all of them.
SAMPLE = [
    "contact_map",
    "contacts_user",
    "message_user",
    "message_tokens_unnest_documents",
    "message_emoji_map",
    "token_dictionary",
    "word_frequency_documents",
    "contact_token_usage_daily_from_who",
    "daily_summary_contact_from_who",
    "summary_contact_events",
    "contact_stats_events",
    "contact_daily_message_volume_events",
    "run_quality_control",
    "resample_week_events",
    "contact_share_events",
    "tapbacks_events",
    "volume_grid_events",
    "side_by_side_events",
    "chat_history_events",
]


def test_names_agree():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("CHATLENS_ALL") else SAMPLE)
def test_same_rows_as_sql(spark, name):
    problem, _ = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], CHECKS[name])
    assert problem == ""


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("CHATLENS_ALL") else SAMPLE)
def test_plan_stays_in_the_jvm_without_cross_joins(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_entry(spark):
    assert entry(spark).count() > 0
