"""One wide row per account: labels, review flag, context sentence and playbook."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyscope.functions.binding import with_sql
from tallyscope.functions.rules import (
    Bands,
    Cond,
    Rule,
    Sql,
    by_bands,
    by_rules,
    by_value,
    condition,
    first_match,
)
from tallyscope.functions.text import joined
from tallyscope.operators import scoring as S
from tallyscope.operators.playbook import PLAYS, Play, with_playbook

VERSION = "phase_14_v3_dashboard_ready_account_intelligence_with_review_reason"

# Status bands, motions, priority ranks and review texts.
STATUS_BANDS = {
    "health_status": Bands(
        S.HEALTH, ((">=", 80, "Healthy"), (">=", 60, "Stable"), (">=", 40, "Weak")), "Unhealthy"
    ),
    "churn_status": Bands(
        S.CHURN,
        ((">=", 60, "Immediate Risk"), (">=", 50, "Elevated Risk"), (">=", 40, "Watch")),
        "Normal",
    ),
    "expansion_status": Bands(
        S.EXPANSION,
        ((">=", 75, "Expansion Ready"), (">=", 50, "Expansion Possible")),
        "No Clear Expansion Signal",
    ),
}
TIER_1_MOTION = "Save"
MOTION_BY_WORD = {
    "Churn": "Recover",
    "Renewal": "Renewal",
    "Expansion": "Expand",
    "Maintain": "Maintain",
}
DEFAULT_MOTION = "Monitor"
MOTIONS = ("Save", "Recover", "Renewal", "Expand", "Maintain", "Monitor")
PRIORITY_RANK = {"Critical": 1, "High": 2, "Medium": 3}

_CRITICAL_PRIORITY = Cond("recommended_action_priority", "=", "Critical")
_WITHIN_30 = Cond(S.RENEWAL, "<=", 30)
_WITHIN_60 = Cond(S.RENEWAL, "<=", 60)
_CHURN_40 = Cond(S.CHURN, ">=", 40)
_OVERDUE_3 = Cond("overdue_action_count", ">=", 3)
REVIEW_REASONS = (
    Rule("Critical recommended action requires leadership review.", (_CRITICAL_PRIORITY,)),
    Rule("Account has critical churn risk.", (Cond("risk_level", "=", "Critical Risk"),)),
    Rule("Account has high churn risk.", (Cond("risk_level", "=", "High Risk"),)),
    Rule(
        "Account is within 30 days of renewal and has meaningful churn risk.",
        (_WITHIN_30, _CHURN_40),
    ),
    Rule("Account is within 30 days of renewal.", (_WITHIN_30,)),
    Rule(
        "Account is within 60 days of renewal and has meaningful churn risk.",
        (_WITHIN_60, _CHURN_40),
    ),
    Rule("Account has {overdue_action_count} overdue actions.", (_OVERDUE_3,)),
)
NO_REVIEW = "No manual review required based on current rules."

LABEL_COLUMNS = (
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
    "risk_level",
    "expansion_level",
    "customer_priority_tier",
    "recommended_action_type",
    "recommended_action_priority",
    "recommended_next_action",
    "suggested_owner_role",
    "recommended_due_date",
    "recommendation_reason",
    "health_status",
    "churn_status",
    "expansion_status",
    "primary_business_motion",
    "dashboard_priority_rank",
    "needs_human_review",
    "human_review_reason",
    "ai_explanation_context",
    "intelligence_view_version",
    "account_name",
)


def _review_reason() -> Sql:
    before, column, after = re.split(r"[{}]", REVIEW_REASONS[-1].result)
    counted = Rule(joined(before, Sql(column), after), REVIEW_REASONS[-1].tests)
    return by_rules([*REVIEW_REASONS[:-1], counted], NO_REVIEW)


def _context_sentence() -> Sql:
    """Fixed wording; unknown values are left out."""
    return joined(
        Sql("company_name"), " is a ", Sql("segment"), " ", Sql("industry"),
        " account on the ", Sql("plan_type"), " plan. Health score is ", Sql(S.HEALTH),
        ", churn risk score is ", Sql(S.CHURN), ", expansion score is ", Sql(S.EXPANSION),
        ". The account is categorized as ", Sql("risk_level"),
        " with ", Sql("expansion_level"),
        ". Recommended action: ", Sql("recommended_action_type"),
        ". Reason: ", Sql("recommendation_reason"),
    )


def account_labels(recommended: DataFrame) -> DataFrame:
    """The wide row without the playbook texts: enough for every filter, order and roll-up."""
    tier = "customer_priority_tier"
    named = recommended.withColumnsRenamed(
        {
            "risk_level_v2": "risk_level",
            "expansion_level_v2": "expansion_level",
            "customer_priority_tier_v3": tier,
        }
    )
    return with_sql(
        named,
        {
            **{name: by_bands(bands) for name, bands in STATUS_BANDS.items()},
            "primary_business_motion": first_match(
                [(f"startswith({tier}, 'Tier 1')", TIER_1_MOTION)]
                + [(f"contains({tier}, '{w}')", motion) for w, motion in MOTION_BY_WORD.items()],
                DEFAULT_MOTION,
            ),
            "dashboard_priority_rank": by_value("recommended_action_priority", PRIORITY_RANK, 4),
            "needs_human_review": first_match(
                [(condition(rule.tests), True) for rule in REVIEW_REASONS], False
            ),
            "human_review_reason": _review_reason(),
            "ai_explanation_context": _context_sentence(),
            "intelligence_view_version": VERSION,
            "account_name": Sql("company_name"),
        },
    ).select(*LABEL_COLUMNS)


def account_intelligence(recommended: DataFrame, plays: Sequence[Play] = PLAYS) -> DataFrame:
    """The playbook is a function of the same row, so it is added in place instead of joined."""
    return with_playbook(account_labels(recommended), plays)
