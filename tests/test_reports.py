from __future__ import annotations

from decimal import Decimal

import pytest
from test_actions_and_labels import recommended

from tallyscope.operators import explore, queues, rollups
from tallyscope.operators import scoring as S
from tallyscope.operators.intelligence import account_labels


def labels(spark, cases):
    return account_labels(recommended(spark, cases))


def ids(df):
    return [row.account_id for row in df.collect()]


def case(tier, churn, days=None, **more):
    return dict(
        customer_priority_tier_v3=tier,
        computed_churn_risk_score=Decimal(churn),
        days_until_renewal=days,
        **more,
    )


RANKED = [
    case(S.MONITOR, "10"),
    case(S.RENEWAL_REVIEW, "45", None, risk_level_v2="Moderate Risk"),
    case(S.RENEWAL_REVIEW, "45", 9, risk_level_v2="Moderate Risk"),
    case(S.SAVE_IMMEDIATELY, "60", 80, risk_level_v2="Critical Risk"),
    case(S.CHURN_INTERVENTION, "70", 300, risk_level_v2="Critical Risk"),
    case(S.CHURN_RISK_WATCH, "55", 300, risk_level_v2="High Risk"),
    case(S.EXPANSION_READY, "10", 70, computed_expansion_score=Decimal("80"),
         expansion_level_v2="High Expansion", open_pipeline_value=Decimal("5")),
    case(S.EXPANSION_NURTURE, "10", 70, computed_expansion_score=Decimal("60")),
    case(S.EXPANSION_READY, "20", None, computed_expansion_score=Decimal("80"),
         expansion_level_v2="High Expansion", open_pipeline_value=Decimal("9")),
]


@pytest.fixture(scope="module")
def ranked(spark):
    return labels(spark, RANKED).cache()


def test_priority_order_puts_unknown_renewal_last(ranked):
    assert ids(queues.accounts_ranked(ranked)) == ["4", "3", "5", "2", "1", "8", "6", "7", "0"]


def test_filtered_lists_keep_their_order(ranked):
    assert ids(queues.high_risk(ranked)) == ["4", "3", "5"]
    assert ids(queues.expansion_ready(ranked)) == ["8", "6"]
    assert ids(queues.review_needed(ranked)) == ["4", "3", "5", "2"]
    assert ids(queues.by_motion(ranked, "Renewal")) == ["2", "1"]
    assert ids(queues.account_by_id(ranked, "3")) == ["3"]
    assert ids(queues.account_by_id(ranked, "none")) == []
    with pytest.raises(ValueError, match="Sideways"):
        queues.by_motion(ranked, "Sideways")


def test_top_lists_number_their_rows(ranked):
    top = queues.top_high_risk(ranked, 2).collect()
    assert [(r.position, r.account_id) for r in top] == [(1, "4"), (2, "3")]
    assert ids(queues.top_expansion(ranked, 1)) == ["6"]
    assert ids(queues.top_review(ranked)) == ["3", "4", "2", "5"]


def test_urgency(ranked):
    found = {r.account_id: r.urgency_score for r in explore.with_urgency(ranked).collect()}
    assert found["3"] == Decimal("1310.00")  # 1000 + 200 + 50 + 60
    assert found["5"] == Decimal("705.00")  # 500 + 100 + 50 + 55
    assert found["0"] == Decimal("10.00")
    # Same priority: churn 45 without a review flag is still ahead of churn 20.
    assert ids(explore.priority_queue(ranked)) == ["4", "3", "5", "2", "1"]
    assert ids(explore.priority_queue(ranked, "expansion ready", 1)) == []
    assert ids(explore.risk_queue(ranked)) == ["4", "3", "5"]
    assert ids(explore.review_queue(ranked)) == ["4", "3", "5", "2"]
    assert ids(explore.expansion_queue(ranked)) == ["8", "6", "4", "3", "5", "2", "1", "0", "7"]


def test_search_ignores_case_and_blank_terms_and_null_fields(spark):
    df = labels(spark, [dict(account_owner=None), dict(account_owner="Zoë B_b%"), dict(segment="ENTERPRISE")])
    assert ids(explore.account_search(df, "  ")) == ["0", "1", "2"]
    assert ids(explore.account_search(df, " zoë b_B%")) == ["1"]
    assert ids(explore.account_search(df, "enterprise")) == ["2"]
    assert ids(explore.account_search(df, "it's")) == []


def test_presets(ranked):
    counts = explore.preset_counts(ranked).first().asDict()
    assert counts == dict(
        all=9, critical_risk=2, high_risk=1, expansion_ready=9, human_review=4, renewal_soon=1
    )
    for preset, size in counts.items():
        assert explore.preset_filter(ranked, preset.replace("_", "-")).count() == size
    assert ids(explore.preset_filter(ranked, "human-review", "", 2)) == ["4", "3"]
    with pytest.raises(ValueError, match="nonsense"):
        explore.preset_filter(ranked, "nonsense")


def test_summaries_keep_their_order(ranked):
    assert [r.risk_level for r in rollups.risk_summary(ranked).collect()] == [
        "Critical Risk", "High Risk", "Moderate Risk", "Low Risk",
    ]
    assert [r.primary_business_motion for r in explore.motion_summary(ranked).collect()] == [
        "Save", "Recover", "Renewal", "Expand", "Monitor",
    ]
    assert [
        (r.recommended_action_priority, r.account_count)
        for r in rollups.action_summary(ranked).collect()
    ][:3] == [("Critical", 1), ("Critical", 1), ("High", 2)]
    assert rollups.owner_workload(ranked).first().suggested_owner_role == (
        "Customer Success Leadership"
    )
    assert rollups.motion_distribution(ranked).first().primary_business_motion == "Expand"


def test_risk_counts_add_up_to_the_kpis(ranked):
    kpis = rollups.dashboard_kpis(ranked).first()
    totals = explore.risk_totals(rollups.risk_summary(ranked)).collect()
    assert kpis.total_accounts == sum(r.account_count for r in totals) == 9
    assert {r.total_accounts for r in totals} == {9}
    assert {r.critical_and_high_accounts for r in totals} == {3}
    assert explore.risk_queue_totals(ranked).first().critical_accounts == 2


def test_action_mix_top_types(ranked):
    rows = explore.action_mix(rollups.action_summary(ranked), 2).collect()
    assert [(r.position, r.recommended_action_type, r.account_count) for r in rows] == [
        (1, "Expansion Discovery", 2),
        (2, "Renewal Readiness Review", 2),
    ]
    assert {r.high_priority_accounts for r in rows} == {7}
    assert [r.tone for r in rows] == ["neutral", "neutral"]


def test_empty_portfolio_gives_unknown_averages_and_sums(spark):
    none = labels(spark, [{}]).where("account_id = 'x'")
    row = rollups.dashboard_kpis(none).first()
    assert row.total_accounts == 0 and row.save_motion_accounts == 0
    assert row.avg_health_score is None and row.total_arr is None and row.arr_at_risk is None
    assert rollups.risk_summary(none).count() == 0


def test_filtered_sum_without_matching_rows_is_unknown(spark):
    row = rollups.dashboard_kpis(labels(spark, [{}])).first()
    assert row.total_arr == Decimal("10.00")
    assert row.arr_at_risk is None and row.high_expansion_pipeline is None


def test_averages_round_half_away_from_zero(spark):
    df = labels(spark, [dict(computed_health_score=Decimal(s)) for s in ("50.00", "50.01")])
    assert rollups.dashboard_kpis(df).first().avg_health_score == Decimal("50.01")


def test_display_bands(spark):
    edges = ["24.99", "25", "39.99", "40", "44.99", "45", "54.99", "55", "69.99", "70", "75"]
    names = ("computed_health_score", "computed_churn_risk_score", "computed_expansion_score")
    df = explore.display_bands(labels(spark, [dict.fromkeys(names, Decimal(s)) for s in edges]))
    rows = sorted(df.collect(), key=lambda r: int(r.account_id))
    assert [r.health_label for r in rows] == (
        ["Unhealthy"] * 5 + ["Needs attention"] * 2 + ["Moderate"] * 2 + ["Stable", "Healthy"]
    )
    assert [r.churn_label for r in rows] == (
        ["Low"] + ["Moderate"] * 2 + ["High"] * 4 + ["Critical"] * 4
    )
    assert [r.expansion_label for r in rows] == (
        ["Low fit"] * 3 + ["Emerging fit"] * 2 + ["Moderate fit"] * 4 + ["Strong fit"] * 2
    )
    assert (rows[0].health_tone, rows[0].churn_tone, rows[0].expansion_tone) == (
        "critical",
        "success",
        "neutral",
    )


def test_lists_from_json_text(spark):
    texts = [None, "", '["a","b"]', "[]", "plain words", '["broken', '["x", null]']
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = df.select("n", explore.steps_from_json(df.t).alias("steps")).orderBy("n").collect()
    assert [r.steps for r in found] == [
        [], [], ["a", "b"], [], ["plain words"], ['["broken'], ["x", None],
    ]


def test_json_lists_keep_the_whole_text(spark):
    cases = ['["a"] tail', '"str"', '["a", "b"]', "[1, null]", '{"a": 1}', "plain", "[", " "]
    df = spark.createDataFrame(list(enumerate(cases)), "n int, t string")
    found = df.select("n", explore.steps_from_json(df.t).alias("steps")).orderBy("n").collect()
    assert [r.steps for r in found] == [
        ['["a"] tail'],
        ["str"],
        ["a", "b"],
        ["1", None],
        ['{"a": 1}'],
        ["plain"],
        ["["],
        [" "],
    ]
