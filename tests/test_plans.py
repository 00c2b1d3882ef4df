"""Plan shapes that matter at scale."""

from __future__ import annotations

import os
import re

import pytest
from conftest import SMALL

from checkset import registry
from tallyscope.operators import quality, queues, rollups

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def portfolio(spark):
    return registry.portfolio(spark, SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_usage_is_combined_before_each_shuffle(portfolio):
    text = plan(portfolio.usage_features)
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("partial_count") >= 2
    # Two grouping sets, not one copy per distinct count.
    (copies,) = re.findall(r"Expand \[(\[.*?\])\], \[", text)
    assert copies.count("[") == 2


def test_accounts_are_joined_on_one_partitioning(spark, portfolio):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(registry.portfolio(spark, SMALL).account_features)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # accounts, usage twice, opportunities, scores, actions, slices of hot keys, both sides of the join
    # that spreads repeated engagement rows, and their counts per key for each side (run once, reused).
    assert text.count("Exchange hashpartitioning") == 11
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rollups_read_no_texts_and_no_score_history(portfolio):
    text = plan(rollups.dashboard_kpis(portfolio.intelligence))
    assert "from_json" not in text and "min_by" not in text and "company_name" not in text
    assert "c_name" not in text


def test_filter_on_a_label_stays_small(portfolio):
    text = plan(queues.high_risk(portfolio.labels).select("account_id"))
    assert len(text) < 60_000
    # One CASE chain per component score; substitution would repeat each of them many times.
    assert text.count("CASE WHEN (usage_events_last_30_days") <= 2


def test_point_lookup_filters_every_scan(portfolio):
    text = plan(queues.account_by_id(portfolio.intelligence, "5"))
    scans = text.count("FileScan parquet")
    assert text.count("= 5)") >= scans - 2  # the two scans that count customers have no filter


def test_top_lists_keep_k_rows_per_task(portfolio):
    assert "TakeOrderedAndProject(limit=10" in plan(queues.top_high_risk(portfolio.labels))


def test_no_python_runs_in_any_query(portfolio):
    for name, relation in registry.RELATIONS.items():
        text = plan(relation(portfolio))
        assert "Python" not in text and "Pandas" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text, name


LISTS = """
accounts_ranked high_risk expansion_ready review_needed by_motion priority_queue preset_filter
risk_queue expansion_queue review_queue
""".split()


def test_list_texts_are_built_after_the_sort(portfolio):
    for name in LISTS:
        text = plan(registry.RELATIONS[name](portfolio))
        # the plan prints from the last step to the first, so what comes before the sort stands below
        above, _, below = text.partition("TakeOrderedAndProject" if "TakeOrdered" in text else "Sort [")
        assert below and "immediate_next_steps" not in below and "__branch" not in below, name
        assert "immediate_next_steps" in above, name


def scans(df) -> int:
    return plan(df).count("FileScan parquet")


def test_quality_reads_each_table_once_a_check(spark, portfolio):
    tables = portfolio.tables
    once = sum(scans(df) for df in tables.values())
    assert scans(quality.primary_keys(spark, tables)) <= once
    assert scans(registry.RELATIONS["row_counts"](portfolio)) <= once + scans(portfolio.recommended)
    # the whole report reads each table once, and only keys, ids and required columns of it
    report = quality.quality_report(spark, tables, registry.EXPECTED_ROWS)
    assert scans(report) <= once
    assert "Join" not in plan(report).replace("BroadcastHashJoin [table_name", "")
    assert len(re.findall(r"Exchange hashpartitioning\(owner", plan(report))) == 1


def test_four_dashboards_from_one_scan(portfolio):
    frame = portfolio.intelligence
    together = rollups.all_rollups(frame)
    assert scans(together) <= scans(rollups.dashboard_kpis(frame))
    text = plan(together)
    assert text.count("Expand [") == 2  # usage features and the four sets
    assert "immediate_next_steps" not in text and "min_by" not in text


def test_unfolded_dashboards_are_those_of_their_own_functions(portfolio):
    frame = portfolio.intelligence
    for rows in (frame, frame.limit(0)):
        unfolded = rollups.unfolded(rollups.all_rollups(rows))
        for name, own in unfolded.items():
            wanted = getattr(rollups, name)(rows)
            assert own.schema.simpleString() == wanted.schema.simpleString(), name
            assert own.collect() == wanted.collect(), name
