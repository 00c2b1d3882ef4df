from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import AS_OF, feature_rows, frame, values

from tallyscope.operators import scoring as S

# Signal values from worst to best rung, with the expected points.
EDGES = {
    "usage_activity_score": (
        "usage_events_last_30_days",
        [(24, 20), (25, 45), (49, 45), (50, 70), (79, 70), (80, 85), (119, 85), (120, 100)],
    ),
    "active_user_score": (
        "active_users_last_30_days",
        [(9, 20), (10, 45), (19, 45), (20, 70), (34, 70), (35, 85), (59, 85), (60, 100)],
    ),
    "nps_score_component": (
        "nps_score",
        [(None, 10), (2, 10), (3, 30), (4, 30), (5, 55), (6, 55), (7, 80), (8, 80), (9, 100)],
    ),
    "engagement_recency_score": (
        "days_since_last_touch",
        [(None, 10), (61, 10), (60, 35), (31, 35), (30, 60), (15, 60), (14, 80), (8, 80), (7, 100)],
    ),
    "support_health_score": (
        "support_tickets_last_30_days",
        [(None, 10), (8, 10), (7, 35), (5, 35), (4, 65), (3, 65), (2, 85), (1, 85), (0, 100), (-1, 85)],
    ),
    "action_discipline_score": (
        "overdue_action_count",
        [(None, 5), (5, 5), (4, 25), (3, 25), (2, 50), (1, 75), (0, 100), (-1, 25)],
    ),
    "renewal_risk_score": (
        "days_until_renewal",
        [(None, 15), (181, 15), (180, 35), (91, 35), (90, 60), (61, 60), (60, 80), (31, 80), (30, 100), (-5, 100)],
    ),
    "pipeline_value_score": (
        "open_pipeline_value",
        [
            (Decimal("0"), 10),
            (Decimal("0.01"), 40),
            (Decimal("49999.99"), 40),
            (Decimal("50000"), 60),
            (Decimal("100000"), 80),
            (Decimal("249999.99"), 80),
            (Decimal("250000"), 100),
        ],
    ),
    "expansion_signal_score": (
        "expansion_opportunity_count",
        [(0, 10), (1, 55), (2, 80), (3, 100), (9, 100)],
    ),
}


@pytest.mark.parametrize("component", EDGES)
def test_component_bands(spark, component):
    signal, edges = EDGES[component]
    df = S.component_scores(feature_rows(spark, [{signal: value} for value, _ in edges]))
    assert values(df, component) == [points for _, points in edges]


def test_every_component_has_edges():
    assert set(EDGES) == set(S.COMPONENT_BANDS)


def test_worked_case(spark):
    case = dict(
        usage_events_last_30_days=8,
        active_users_last_30_days=7,
        nps_score=3,
        support_tickets_last_30_days=9,
        days_until_renewal=75,
        overdue_action_count=2,
    )
    v3 = S.score_v3(S.score_v2(S.score_v1(feature_rows(spark, [case]), AS_OF)))
    row = v3.first()
    assert row.computed_churn_risk_score == Decimal("72.00")
    assert str(row.computed_churn_risk_score) == "72.00"
    # 18.50 * 0.65 = 12.025, rounded half away from zero.
    assert (row.raw_expansion_score, row.computed_expansion_score) == (
        Decimal("18.50"),
        Decimal("12.03"),
    )
    assert row.customer_priority_tier_v3 == "Tier 1 - Save Immediately"
    assert row.customer_priority_tier == "Tier 2 - Renewal Risk Watch"
    assert row.scoring_model_version == "phase_12_v1_fixed_reference_2024_02_05"


def test_best_account_scores_100_health(spark):
    case = dict(
        usage_events_last_30_days=500,
        active_users_last_30_days=500,
        nps_score=10,
        days_since_last_touch=0,
        open_pipeline_value=Decimal("999999"),
        expansion_opportunity_count=9,
    )
    row = S.score_v1(feature_rows(spark, [case]), AS_OF).first()
    assert row.computed_health_score == Decimal("100.00")
    assert row.computed_expansion_score == row.raw_expansion_score == Decimal("100.00")
    assert row.computed_churn_risk_score == Decimal("2.25")


SCORE_TYPES = dict(
    computed_health_score="decimal(5,2)",
    computed_churn_risk_score="decimal(5,2)",
    computed_expansion_score="decimal(5,2)",
    days_until_renewal="int",
)
# churn, renewal days, expansion, health -> tier without its level prefix, per version.
TIERS = [
    ("75.00", 90, "0", "0", "Save Immediately", "Save Immediately", "Save Immediately"),
    ("75.00", 91, "0", "0", "Churn Intervention", "Churn Intervention", "Churn Intervention"),
    ("75.00", None, "0", "0", "Churn Intervention", "Churn Intervention", "Churn Intervention"),
    ("74.99", 120, "0", "0", "Renewal Risk Watch", "Churn Intervention", "Churn Intervention"),
    ("60.00", 90, "0", "0", "Renewal Risk Watch", "Save Immediately", "Save Immediately"),
    ("60.00", 121, "90", "0", "Monitor", "Churn Intervention", "Churn Intervention"),
    ("59.99", 120, "90", "0", "Expansion Nurture", "Renewal Risk Watch", "Renewal Risk Watch"),
    ("50.00", 121, "90", "0", "Expansion Nurture", "Churn Risk Watch", "Churn Risk Watch"),
    ("50.00", None, "0", "0", "Monitor", "Churn Risk Watch", "Churn Risk Watch"),
    ("49.99", 30, "75", "0", "Expansion Ready", "Expansion Nurture", "Renewal Review"),
    ("40.00", 31, "75", "0", "Expansion Ready", "Expansion Ready", "Renewal Monitor"),
    ("40.00", 60, "75", "0", "Expansion Ready", "Expansion Ready", "Renewal Monitor"),
    ("40.00", 61, "75", "0", "Expansion Ready", "Expansion Ready", "Expansion Ready"),
    ("45.00", 61, "75", "0", "Expansion Ready", "Expansion Nurture", "Expansion Ready"),
    ("39.99", 60, "75", "0", "Expansion Ready", "Expansion Ready", "Renewal Expansion Review"),
    ("39.99", None, "75", "0", "Expansion Ready", "Expansion Ready", "Expansion Ready"),
    ("39.99", 10, "74.99", "0", "Expansion Nurture", "Expansion Nurture", "Expansion Nurture"),
    ("39.99", 10, "60.00", "0", "Expansion Nurture", "Expansion Nurture", "Expansion Nurture"),
    ("39.99", 10, "59.99", "65.00", "Maintain", "Maintain", "Maintain"),
    ("39.99", 10, "59.99", "64.99", "Monitor", "Monitor", "Monitor"),
    ("40.00", 61, "59.99", "65.00", "Monitor", "Monitor", "Monitor"),
]


def test_tiers_of_the_three_versions(spark):
    cases = [
        dict(
            computed_churn_risk_score=Decimal(churn),
            days_until_renewal=days,
            computed_expansion_score=Decimal(growth),
            computed_health_score=Decimal(health),
        )
        for churn, days, growth, health, *_ in TIERS
    ]
    df = S.score_v3(S.score_v2(S.label(frame(spark, SCORE_TYPES, {}, cases), S.model_v1(AS_OF))))
    found = values(
        df, "customer_priority_tier", "customer_priority_tier_v2", "customer_priority_tier_v3"
    )
    assert [tuple(t[9:] for t in row) for row in found] == [case[4:] for case in TIERS]


def test_levels_at_their_edges(spark):
    scores = ["39.99", "40.00", "49.99", "50.00", "59.99", "60.00", "74.99", "75.00"]
    cases = [
        dict(
            computed_churn_risk_score=Decimal(s),
            computed_expansion_score=Decimal(s),
            computed_health_score=Decimal(0),
            days_until_renewal=None,
        )
        for s in scores
    ]
    df = S.score_v2(S.label(frame(spark, SCORE_TYPES, {}, cases), S.model_v1(AS_OF)))
    found = values(df, "risk_level", "risk_level_v2", "expansion_level_v2")
    assert [r[0].split()[0] for r in found] == ["Low"] + ["Moderate"] * 4 + ["High"] * 2 + ["Critical"]
    assert [r[1].split()[0] for r in found] == (
        ["Low", "Moderate", "Moderate", "High", "High", "Critical", "Critical", "Critical"]
    )
    assert [r[2].split()[0] for r in found] == ["Low"] * 3 + ["Medium"] * 4 + ["High"]


def test_expansion_damping_takes_the_first_step_that_applies(spark):
    cases = []
    # churn = 100-based sum; reach 54.x, 55.x and 70.x through the signals.
    for nps, tickets, overdue, days in ((9, 0, 0, 200), (0, 9, 5, 200), (0, 9, 5, 30)):
        cases.append(
            dict(
                nps_score=nps,
                support_tickets_last_30_days=tickets,
                overdue_action_count=overdue,
                days_until_renewal=days,
                usage_events_last_30_days=200,
                active_users_last_30_days=15,
            )
        )
    cases.append({**cases[2], "usage_events_last_30_days": 0, "active_users_last_30_days": 0})
    rows = values(
        S.composite_scores(S.component_scores(feature_rows(spark, cases))),
        "computed_churn_risk_score",
        "raw_expansion_score",
        "computed_expansion_score",
    )
    for churn, raw, damped in rows:
        factor = "0.65" if churn >= 70 else "0.85" if churn >= 55 else "1"
        assert damped == (raw * Decimal(factor)).quantize(Decimal("0.01"), "ROUND_HALF_UP")
    assert {churn >= 55 for churn, _, _ in rows} == {True, False}
    assert any(churn >= 70 for churn, _, _ in rows)
