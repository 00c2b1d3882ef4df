"""The recommended action of each account, read off its priority tier."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame

from tallyscope.functions.binding import bind_once
from tallyscope.functions.rules import Sql, aliased, by_prefix, by_value, first_match, one_of
from tallyscope.functions.text import joined
from tallyscope.operators import scoring as S

# Action type and next-action sentence per tier; the last entry is the default.
ACTION_TYPES = {
    S.SAVE_IMMEDIATELY: "Executive Renewal Save Plan",
    S.CHURN_INTERVENTION: "Immediate Churn Intervention",
    S.RENEWAL_RISK_WATCH: "Renewal Risk Review",
    S.CHURN_RISK_WATCH: "CSM Risk Review",
    S.RENEWAL_REVIEW: "Renewal Readiness Review",
    S.RENEWAL_EXPANSION_REVIEW: "Renewal and Expansion Review",
    S.EXPANSION_READY: "Expansion Discovery",
    S.RENEWAL_MONITOR: "Renewal Monitoring",
    S.EXPANSION_NURTURE: "Expansion Nurture",
    S.MAINTAIN: "Maintain Account Health",
    S.MONITOR: "Monitor Account",
}
NEXT_ACTIONS = {
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
# Priority, owner role and days to act by tier level.
PRIORITY_BY_LEVEL = {"Tier 1": "Critical", "Tier 2": "High", "Tier 3": "Medium"}
SALES_OWNED = (S.EXPANSION_READY, S.RENEWAL_EXPANSION_REVIEW)
OWNER_BY_LEVEL = {
    "Tier 1": "Customer Success Leadership",
    "Tier 2": "Customer Success Manager",
    "Tier 3": "Account Owner",
}
DAYS_BY_TIER = {S.SAVE_IMMEDIATELY: 1, S.CHURN_INTERVENTION: 2}
DAYS_BY_LEVEL = {"Tier 2": 5, "Tier 3": 14}

CARRIED = (
    "account_id",
    "company_name",
    "industry",
    "segment",
    "company_size",
    "annual_recurring_revenue",
    "plan_type",
    "customer_stage",
    "account_owner",
    "renewal_date",
    "days_until_renewal",
    "usage_events_last_30_days",
    "active_users_last_30_days",
    "support_tickets_last_30_days",
    "nps_score",
    "overdue_action_count",
    "open_pipeline_value",
    "computed_health_score",
    "computed_churn_risk_score",
    "computed_expansion_score",
    "risk_level_v2",
    "expansion_level_v2",
    "customer_priority_tier_v3",
)
BOUND = ("risk_level_v2", "expansion_level_v2", "customer_priority_tier_v3")


def recommended_actions(scored_v3: DataFrame, as_of: date) -> DataFrame:
    tier = "customer_priority_tier_v3"
    health, churn, growth, days = map(Sql, (S.HEALTH, S.CHURN, S.EXPANSION, S.RENEWAL))

    def due(days_from_today: int) -> Sql:
        return Sql(f"DATE'{as_of + timedelta(days=days_from_today)}'")

    # Wording of the reason by tier level; unknown numbers are left out.
    scores = (
        " with health score of ", health, ", churn risk score of ", churn,
        ", and expansion score of ", growth, ".",
    )
    reasons = {
        "Tier 1": joined(
            "High churn risk score of ", churn, ", health score of ", health, ", ",
            days, " days until renewal, ",
            Sql("usage_events_last_30_days"), " usage events in the last 30 days, ",
            Sql("support_tickets_last_30_days"), " support tickets, and ",
            Sql("overdue_action_count"), " overdue actions.",
        ),
        "Tier 2": joined(
            "Priority driven by ", Sql("risk_level_v2"), ", ", Sql("expansion_level_v2"), ", ",
            days, " days until renewal, churn risk score of ", churn,
            ", and expansion score of ", growth, ".",
        ),
        "Tier 3": joined("Account has manageable risk", *scores),
    }
    low_urgency = joined("Account currently has low urgency", *scores)

    labelled = bind_once(
        scored_v3,
        tuple(name for name in CARRIED if name not in BOUND),
        {name: Sql(name) for name in BOUND},
    )
    return labelled.select(*CARRIED).selectExpr(
        "*",
        *aliased(
            {
                "recommended_action_type": by_value(tier, ACTION_TYPES, ACTION_TYPES[S.MONITOR]),
                "recommended_action_priority": by_prefix(tier, PRIORITY_BY_LEVEL, "Low"),
                "recommended_next_action": by_value(tier, NEXT_ACTIONS, NEXT_ACTIONS[S.MONITOR]),
                "suggested_owner_role": first_match(
                    [(one_of(tier, SALES_OWNED), "Account Executive")],
                    by_prefix(tier, OWNER_BY_LEVEL, "Revenue Operations"),
                ),
                "recommended_due_date": by_value(
                    tier,
                    {name: due(n) for name, n in DAYS_BY_TIER.items()},
                    by_prefix(tier, {name: due(n) for name, n in DAYS_BY_LEVEL.items()}, due(30)),
                ),
                "recommendation_reason": by_prefix(tier, reasons, low_urgency),
                "recommendation_model_version": "phase_13_v1_rule_based_recommended_actions",
            }
        ),
    )
