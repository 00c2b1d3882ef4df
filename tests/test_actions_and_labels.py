from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from conftest import AS_OF, feature_rows, frame, values
from test_playbook import QUIET, TYPES

from tallyscope.operators import scoring as S
from tallyscope.operators.actions import ACTION_TYPES, CARRIED, recommended_actions
from tallyscope.operators.intelligence import account_labels

SCORED_TYPES = {
    **{n: t for n, t in TYPES.items() if n in CARRIED},
    "industry": "string",
    "segment": "string",
    "company_size": "int",
    "annual_recurring_revenue": "decimal(12,2)",
    "plan_type": "string",
    "customer_stage": "string",
    "renewal_date": "date",
    "open_pipeline_value": "decimal(22,2)",
}
SCORED = {
    **QUIET,
    **dict(
        industry="FinTech",
        segment="Startup",
        company_size=1,
        annual_recurring_revenue=Decimal("10.00"),
        plan_type="Starter",
        customer_stage="Active",
        renewal_date=None,
        open_pipeline_value=Decimal("0.00"),
    ),
}


def recommended(spark, cases):
    return recommended_actions(frame(spark, SCORED_TYPES, SCORED, cases), AS_OF)


SENTENCES = {
    S.SAVE_IMMEDIATELY: "Schedule an executive renewal save call, review product issues, confirm renewal blockers, and create a save plan within 24 hours.",
    S.CHURN_INTERVENTION: "Open an urgent churn intervention plan with the account owner, identify adoption blockers, review support issues, and define recovery actions.",
    S.RENEWAL_RISK_WATCH: "Review renewal readiness, inspect product usage, check support pressure, and prepare a renewal risk mitigation plan.",
    S.CHURN_RISK_WATCH: "Ask the account owner to review account health, validate customer sentiment, and decide whether escalation is needed.",
    S.RENEWAL_REVIEW: "Review renewal status immediately because the account is close to renewal and has moderate churn risk.",
    S.RENEWAL_EXPANSION_REVIEW: "Prepare a renewal conversation and evaluate expansion only if customer sentiment and product adoption are stable.",
    S.EXPANSION_READY: "Start expansion discovery with the account owner, identify additional use cases, and validate budget or pipeline opportunity.",
    S.RENEWAL_MONITOR: "Monitor renewal readiness, confirm next touchpoint, and check whether usage or sentiment declines.",
    S.EXPANSION_NURTURE: "Nurture the account for expansion by tracking usage, identifying active teams, and preparing a future upsell conversation.",
    S.MAINTAIN: "Maintain regular account engagement and continue monitoring health signals.",
    S.MONITOR: "No immediate action required. Continue monitoring account health, usage, support pressure, and renewal timing.",
}


def test_each_tier_has_its_action(spark):
    # tier -> priority, role, days
    expected = {
        S.SAVE_IMMEDIATELY: ("Critical", "Customer Success Leadership", 1),
        S.CHURN_INTERVENTION: ("Critical", "Customer Success Leadership", 2),
        S.RENEWAL_RISK_WATCH: ("High", "Customer Success Manager", 5),
        S.CHURN_RISK_WATCH: ("High", "Customer Success Manager", 5),
        S.RENEWAL_REVIEW: ("High", "Customer Success Manager", 5),
        S.RENEWAL_EXPANSION_REVIEW: ("High", "Account Executive", 5),
        S.EXPANSION_READY: ("High", "Account Executive", 5),
        S.RENEWAL_MONITOR: ("Medium", "Account Owner", 14),
        S.EXPANSION_NURTURE: ("Medium", "Account Owner", 14),
        S.MAINTAIN: ("Medium", "Account Owner", 14),
        S.MONITOR: ("Low", "Revenue Operations", 30),
    }
    df = recommended(spark, [dict(customer_priority_tier_v3=tier) for tier in expected])
    found = values(
        df,
        "recommended_action_type",
        "recommended_next_action",
        "recommended_action_priority",
        "suggested_owner_role",
        "recommended_due_date",
    )
    assert found == [
        (ACTION_TYPES[t], SENTENCES[t], priority, role, AS_OF + timedelta(days=days))
        for t, (priority, role, days) in expected.items()
    ]
    assert len(set(ACTION_TYPES.values())) == 11


def test_reasons_leave_out_unknown_numbers(spark):
    cases = [
        dict(customer_priority_tier_v3=S.SAVE_IMMEDIATELY, days_until_renewal=None),
        dict(customer_priority_tier_v3=S.RENEWAL_REVIEW),
        dict(customer_priority_tier_v3=S.MAINTAIN),
        dict(customer_priority_tier_v3=S.MONITOR),
    ]
    assert values(recommended(spark, cases), "recommendation_reason") == [
        "High churn risk score of 41.00, health score of 51.50,  days until renewal, 20 usage"
        " events in the last 30 days, 2 support tickets, and 1 overdue actions.",
        "Priority driven by Low Risk, Low Expansion, 123 days until renewal, churn risk score of"
        " 41.00, and expansion score of 61.25.",
        "Account has manageable risk with health score of 51.50, churn risk score of 41.00, and"
        " expansion score of 61.25.",
        "Account currently has low urgency with health score of 51.50, churn risk score of 41.00,"
        " and expansion score of 61.25.",
    ]


def test_motions_and_status_bands(spark):
    tiers = list(ACTION_TYPES)
    df = account_labels(recommended(spark, [dict(customer_priority_tier_v3=t) for t in tiers]))
    assert values(df, "primary_business_motion") == [
        "Save", "Save", "Renewal", "Recover", "Renewal", "Renewal", "Expand", "Renewal", "Expand",
        "Maintain", "Monitor",
    ]
    assert values(df, "dashboard_priority_rank") == [1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 4]
    scores = ["39.99", "40", "49.99", "50", "59.99", "60", "74.99", "75", "79.99", "80"]
    names = ("computed_health_score", "computed_churn_risk_score", "computed_expansion_score")
    df = account_labels(recommended(spark, [dict.fromkeys(names, Decimal(s)) for s in scores]))
    assert values(df, "health_status") == (
        ["Unhealthy"] + ["Weak"] * 4 + ["Stable"] * 4 + ["Healthy"]
    )
    assert values(df, "churn_status") == (
        ["Normal"] + ["Watch"] * 2 + ["Elevated Risk"] * 2 + ["Immediate Risk"] * 5
    )
    assert values(df, "expansion_status") == (
        ["No Clear Expansion Signal"] * 3 + ["Expansion Possible"] * 4 + ["Expansion Ready"] * 3
    )


def test_review_flag_and_reason_agree(spark):
    low = dict(risk_level_v2="Low Risk", computed_churn_risk_score=Decimal("39.99"))
    some = dict(risk_level_v2="Moderate Risk", computed_churn_risk_score=Decimal("40"))
    cases = [
        (dict(customer_priority_tier_v3=S.SAVE_IMMEDIATELY), "Critical recommended action"),
        (dict(risk_level_v2="Critical Risk"), "Account has critical churn risk."),
        (dict(risk_level_v2="High Risk"), "Account has high churn risk."),
        (dict(some, days_until_renewal=30), "Account is within 30 days of renewal and has"),
        (dict(low, days_until_renewal=30), "Account is within 30 days of renewal."),
        (dict(some, days_until_renewal=60), "Account is within 60 days of renewal and has"),
        (dict(low, days_until_renewal=60), None),
        (dict(some, days_until_renewal=61), None),
        (dict(some, days_until_renewal=None), None),
        (dict(low, overdue_action_count=3), "Account has 3 overdue actions."),
        (dict(low, overdue_action_count=2), None),
    ]
    df = account_labels(recommended(spark, [case for case, _ in cases]))
    for (flag, reason), (_, start) in zip(
        values(df, "needs_human_review", "human_review_reason"), cases, strict=True
    ):
        assert flag is (start is not None)
        assert reason.startswith(start or "No manual review required")


def test_context_sentence(spark):
    row = account_labels(recommended(spark, [dict(segment=None)])).first()
    assert row.ai_explanation_context == (
        "Acme is a  FinTech account on the Starter plan. Health score is 51.50, churn risk score is"
        " 41.00, expansion score is 61.25. The account is categorized as Low Risk with Low"
        f" Expansion. Recommended action: Monitor Account. Reason: {row.recommendation_reason}"
    )
    assert row.account_name == "Acme" and row.recommended_due_date == date(2024, 3, 6)


def test_scores_reach_the_action(spark):
    v3 = S.score_v3(S.score_v2(S.score_v1(feature_rows(spark, [{}]), AS_OF)))
    assert recommended_actions(v3, AS_OF).count() == 1
