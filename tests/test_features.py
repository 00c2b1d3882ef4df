from __future__ import annotations

from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import AS_OF, table
from pyspark.sql import functions as F

from tallyscope.operators import features as feat
from tallyscope.operators.joins import fan_out_left_join

MIDNIGHT = datetime(AS_OF.year, AS_OF.month, AS_OF.day)


def events(spark, *rows):
    return table(
        spark,
        "product_usage_events",
        *[dict(event_id=str(n), account_id="a", **row) for n, row in enumerate(rows)],
    )


def test_usage_windows_include_midnight_and_have_no_upper_bound(spark):
    edge = MIDNIGHT - timedelta(days=30)
    week = MIDNIGHT - timedelta(days=7)
    row = feat.usage_features(
        events(
            spark,
            dict(user_id="u", feature_name="f", event_timestamp=edge),
            dict(user_id="u", feature_name="f", event_timestamp=edge - timedelta(microseconds=1)),
            dict(user_id="v", feature_name="g", event_timestamp=week),
            dict(user_id="w", feature_name="g", event_timestamp=MIDNIGHT + timedelta(days=3)),
        ),
        AS_OF,
    ).first()
    assert row.total_usage_events == 4
    assert row.usage_events_last_30_days == 3
    assert row.usage_events_last_7_days == 2
    assert (row.active_users_total, row.active_users_last_30_days) == (3, 3)
    assert row.distinct_features_used == 2
    assert row.days_since_last_product_event == -3


def test_usage_counts_known_users_and_features_only(spark):
    old = MIDNIGHT - timedelta(days=90)
    row = feat.usage_features(
        events(
            spark,
            dict(user_id=None, feature_name="f", event_timestamp=MIDNIGHT),
            dict(user_id="u", feature_name=None, event_timestamp=old),
            dict(user_id="u", feature_name=None, event_timestamp=None),
        ),
        AS_OF,
    ).first()
    assert (row.total_usage_events, row.usage_events_last_30_days) == (3, 1)
    assert (row.active_users_total, row.active_users_last_30_days) == (1, 0)
    assert row.distinct_features_used == 1
    assert row.avg_session_duration_minutes is None


def test_usage_average_rounds_half_away_from_zero(spark):
    minutes = [Decimal("0.12"), Decimal("0.13"), None]
    rows = [
        dict(user_id=str(n), session_duration_minutes=m, event_timestamp=MIDNIGHT)
        for n, m in enumerate(minutes)
    ]
    assert feat.usage_features(events(spark, *rows), AS_OF).first()[
        "avg_session_duration_minutes"
    ] == Decimal("0.13")


def test_usage_equals_plain_distinct_counts_with_a_hot_account(spark):
    spark.range(20000).selectExpr(
        "cast(id as string) event_id",
        "if(id % 3 = 0, 'hot', cast(id % 50 as string)) account_id",
        "if(id % 11 = 0, null, concat('u', id % 700)) user_id",
        "'click' event_type",
        "concat('f', id % 9) feature_name",
        "cast(id % 100 as decimal(10,2)) session_duration_minutes",
        "timestampadd(HOUR, cast(-(id % 2000) as int), timestamp_ntz'2024-02-05') event_timestamp",
    ).createOrReplaceTempView("skewed_events")
    ours = feat.usage_features(spark.table("skewed_events"), AS_OF)
    plain = spark.sql("""
        SELECT account_id, count(*) total_usage_events,
          count(DISTINCT user_id) active_users_total,
          count(DISTINCT user_id) FILTER (WHERE event_timestamp >= timestamp_ntz'2024-01-06')
            active_users_last_30_days,
          count(DISTINCT feature_name) distinct_features_used
        FROM skewed_events GROUP BY account_id""")
    assert sorted(ours.select(*plain.columns).collect()) == sorted(plain.collect())


def test_action_overdue_is_strict_and_only_for_active(spark):
    rows = [
        ("Pending", "Critical", AS_OF),
        ("Pending", "High", AS_OF - timedelta(days=1)),
        ("In Progress", "Low", AS_OF - timedelta(days=9)),
        ("Completed", "Low", AS_OF - timedelta(days=9)),
        ("Dismissed", None, None),
        (None, "Critical", AS_OF - timedelta(days=20)),
    ]
    df = table(
        spark,
        "actions",
        *[
            dict(action_id=str(n), account_id="a", status=s, priority=p, due_date=d)
            for n, (s, p, d) in enumerate(rows)
        ],
    )
    row = feat.action_features(df, AS_OF).first()
    assert (row.total_action_count, row.active_action_count, row.overdue_action_count) == (6, 3, 2)
    assert (row.pending_action_count, row.in_progress_action_count) == (2, 1)
    assert (row.completed_action_count, row.dismissed_action_count) == (1, 1)
    assert (row.high_priority_action_count, row.critical_action_count) == (3, 2)
    assert row.next_open_action_due_date == AS_OF - timedelta(days=9)


def test_opportunity_stage_null_is_not_open_and_expansion_counts_closed(spark):
    rows = [
        ("Proposal", "Renewal", "100.10", 33, date(2024, 3, 1)),
        (None, "EXPANSION deal", "50.00", 10, date(2024, 2, 1)),
        ("Closed Won", "Seat Upsell", "70.00", 100, date(2024, 1, 1)),
    ]
    df = table(
        spark,
        "crm_opportunities",
        *[
            dict(
                opportunity_id=str(n),
                account_id="a",
                pipeline_stage=s,
                opportunity_type=t,
                amount=Decimal(m),
                probability=p,
                expected_close_date=d,
                last_activity_date=AS_OF - timedelta(days=n),
            )
            for n, (s, t, m, p, d) in enumerate(rows)
        ],
    )
    row = feat.opportunity_features(df, AS_OF).first()
    assert (row.total_opportunity_count, row.open_opportunity_count) == (3, 1)
    assert row.open_pipeline_value == Decimal("100.10")
    assert row.weighted_pipeline_value == Decimal("33.0330")
    assert row.next_expected_close_date == date(2024, 3, 1)
    assert (row.days_since_last_crm_activity, row.expansion_opportunity_count) == (0, 2)


def test_opportunity_without_open_rows_sums_to_zero(spark):
    df = table(
        spark,
        "crm_opportunities",
        dict(opportunity_id="1", account_id="a", pipeline_stage="Closed Lost", amount=Decimal("5")),
    )
    row = feat.opportunity_features(df, AS_OF).first()
    assert row.open_pipeline_value == 0 and row.weighted_pipeline_value == 0
    assert row.next_expected_close_date is None


def test_latest_score_prefers_missing_date_then_newest_then_lowest_id(spark):
    rows = [
        ("s3", "a", date(2024, 1, 1)),
        ("s2", "a", date(2024, 1, 1)),
        ("s1", "a", date(2023, 1, 1)),
        ("s9", "b", None),
        ("s8", "b", date(2024, 2, 1)),
    ]
    df = table(
        spark,
        "score_history",
        *[dict(score_id=s, account_id=a, calculated_at=d) for s, a, d in rows],
    )
    found = {r.account_id: r.score_id for r in feat.latest_scores(df).collect()}
    assert found == {"a": "s2", "b": "s9"}


def test_engagement_labels_at_their_edges(spark):
    rows = [
        dict(emails_opened=0, emails_replied=3, nps_score=None, support_tickets_last_30_days=3),
        dict(emails_opened=3, emails_replied=1, nps_score=4, support_tickets_last_30_days=4),
        dict(emails_opened=None, nps_score=5, meetings_last_30_days=1, support_tickets_last_30_days=8),
        dict(emails_opened=8, emails_replied=1, nps_score=8, meetings_last_30_days=2),
    ]
    df = table(
        spark,
        "customer_engagement",
        *[dict(engagement_id=str(n), account_id=str(n), **row) for n, row in enumerate(rows)],
    )
    found = sorted(feat.engagement_features(df, AS_OF).collect(), key=lambda r: r.account_id)
    assert [str(r.email_reply_rate_percent) for r in found] == ["0.00", "33.33", "0.00", "12.50"]
    assert [r.nps_category for r in found] == ["detractor", "detractor", "neutral", "promoter"]
    assert [r.meeting_engagement_level for r in found] == ["low", "low", "medium", "high"]
    assert [r.support_pressure_level for r in found] == ["low", "medium", "high", "low"]


def base(spark, engagement_rows):
    return {
        "accounts": table(
            spark,
            "accounts",
            dict(account_id="a", company_name="A", renewal_date=AS_OF + timedelta(days=3)),
            dict(account_id="b", company_name="B"),
        ),
        "product_usage_events": table(spark, "product_usage_events"),
        "customer_engagement": table(spark, "customer_engagement", *engagement_rows),
        "crm_opportunities": table(spark, "crm_opportunities"),
        "score_history": table(spark, "score_history"),
        "actions": table(spark, "actions"),
    }


def test_account_without_any_rows_gets_zeros_and_unknowns(spark):
    found = feat.account_features(base(spark, []), AS_OF)
    assert tuple(found.columns) == feat.FEATURE_COLUMNS and len(found.columns) == 57
    row = found.where("account_id = 'a'").first().asDict()
    assert row["days_until_renewal"] == 3
    for name in feat.ZERO_FILLED:
        assert row[name] == 0, name
    joined = set(feat.FEATURE_COLUMNS) - {"account_id", *feat.ACCOUNT_COLUMNS, "days_until_renewal"}
    for name in joined - feat.ZERO_FILLED:
        assert row[name] is None, name


def test_repeated_engagement_row_fans_out_and_is_not_dropped(spark):
    rows = [dict(engagement_id=str(n), account_id="a", nps_score=n) for n in range(3)]
    found = feat.account_features(base(spark, rows), AS_OF).select("account_id", "nps_score")
    assert sorted((r.account_id, r.nps_score) for r in found.collect() if r.account_id == "a") == [
        ("a", 0),
        ("a", 1),
        ("a", 2),
    ]
    assert found.where("account_id = 'b'").count() == 1


def test_fan_out_join_equals_left_join_with_a_hot_key(spark):
    one = spark.range(40).selectExpr("cast(id as string) k", "id * 2 as v")
    many = spark.range(3000).selectExpr(
        "if(id % 3 = 0, '7', cast(id % 30 as string)) k", "cast(id as string) row_id"
    )
    ours = fan_out_left_join(one, many, "k", "row_id", rows_per_slice=100)
    plain = one.join(many, "k", "left")
    assert sorted(map(tuple, ours.select(*plain.columns).na.fill("-").collect())) == sorted(
        map(tuple, plain.na.fill("-").collect())
    )


@pytest.mark.parametrize("row_id", ["cast(NULL as string)", "'same'", "cast(id as string)"])
def test_fan_out_join_adds_no_row_where_slices_are_empty(spark, row_id):
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "k string, v int")
    many = spark.range(500).selectExpr(
        "CASE WHEN id < 400 THEN 'a' WHEN id < 490 THEN 'b' END k", f"{row_id} row_id", "id w"
    )
    found = fan_out_left_join(one, many, "k", "row_id", rows_per_slice=100)
    plain = one.join(many, "k", "left").select(*found.columns)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect()))


def test_fan_out_join_slices_by_measured_counts(spark, monkeypatch):
    """A key with a third of the rows is dealt over as many tasks as it needs; the others stay whole."""
    one = spark.range(100).selectExpr("cast(id as string) k")
    many = spark.range(30_000).selectExpr("if(id % 3 = 0, '7', cast(id % 100 as string)) k", "id row_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = fan_out_left_join(one, many, "k", "row_id", rows_per_slice=500).withColumn(
            "task", F.spark_partition_id()
        )
        tasks = {r["k"]: r["n"] for r in placed.groupBy("k").agg(F.countDistinct("task").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert tasks.pop("7") > 2 and set(tasks.values()) == {1}
