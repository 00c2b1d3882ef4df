"""Ranked and filtered account lists, over intelligence rows or over the labels alone.

Sorting labels and adding the texts afterwards (``Portfolio.with_texts``) keeps the texts out of
the shuffle.

Orders end in ``account_id`` so that they are total; NULLs sort as in the reports (last going up,
first going down). Full lists are range-partitioned sorts, limited ones keep a top-k per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.rules import by_value
from tallyscope.operators import scoring as S
from tallyscope.operators.intelligence import MOTIONS, PRIORITY_RANK
from tallyscope.operators.rollups import AT_RISK

LIST_COLUMNS = (
    "account_id",
    "company_name",
    "industry",
    "segment",
    "company_size",
    "annual_recurring_revenue",
    "plan_type",
    "customer_stage",
    "account_owner",
    "days_until_renewal",
    "computed_health_score",
    "computed_churn_risk_score",
    "computed_expansion_score",
    "risk_level",
    "expansion_level",
    "customer_priority_tier",
    "health_status",
    "churn_status",
    "expansion_status",
    "primary_business_motion",
    "recommended_action_type",
    "recommended_action_priority",
    "suggested_owner_role",
    "recommended_due_date",
    "needs_human_review",
    "human_review_reason",
    "recommended_next_action",
    "recommendation_reason",
    "ai_explanation_context",
    "immediate_next_steps",
    "phase_2_next_steps",
    "success_metrics",
    "escalation_guidance",
    "timeline_label",
    "playbook_version",
)


def priority_order() -> list[Column]:
    return [
        F.col("dashboard_priority_rank").asc_nulls_last(),
        F.col(S.CHURN).desc_nulls_first(),
        F.col(S.RENEWAL).asc_nulls_last(),
        F.col("account_id").asc(),
    ]


def top(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their position.

    Each task keeps its first ``limit`` rows and one task sorts what is left, so this is for limits
    of report size; for long lists sort without a limit.
    """
    first = df.orderBy(*order).limit(limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def accounts_ranked(intelligence: DataFrame) -> DataFrame:
    return intelligence.orderBy(*priority_order())


def listed(intelligence: DataFrame) -> DataFrame:
    """The columns of an account list entry."""
    return intelligence.select(*LIST_COLUMNS)


def high_risk(intelligence: DataFrame) -> DataFrame:
    return intelligence.where(F.col("risk_level").isin(*AT_RISK)).orderBy(
        F.col(S.CHURN).desc_nulls_first(), F.col(S.RENEWAL).asc_nulls_last(), "account_id"
    )


def expansion_ready(intelligence: DataFrame) -> DataFrame:
    return intelligence.where(F.col("expansion_level") == "High Expansion").orderBy(
        F.col(S.EXPANSION).desc_nulls_first(),
        F.col("open_pipeline_value").desc_nulls_first(),
        "account_id",
    )


def review_needed(intelligence: DataFrame) -> DataFrame:
    return intelligence.where("needs_human_review").orderBy(*priority_order())


def by_motion(intelligence: DataFrame, motion: str) -> DataFrame:
    if motion not in MOTIONS:
        raise ValueError(f"unknown motion {motion!r}, expected one of {', '.join(MOTIONS)}")
    return intelligence.where(F.col("primary_business_motion") == motion).orderBy(
        *priority_order()
    )


def account_by_id(intelligence: DataFrame, account_id: str) -> DataFrame:
    """The rows of one account, one for each engagement row it has; the filter reaches all scans."""
    return intelligence.where(F.col("account_id") == account_id)


def top_high_risk(intelligence: DataFrame, limit: int = 10) -> DataFrame:
    return top(
        intelligence.where(F.col("risk_level").isin(*AT_RISK)).select(
            "account_id",
            "company_name",
            "risk_level",
            "computed_churn_risk_score",
            "computed_health_score",
            "recommended_action_type",
            "suggested_owner_role",
            "days_until_renewal",
        ),
        [F.col(S.CHURN).desc(), F.col("account_id").asc()],
        limit,
    )


def top_expansion(intelligence: DataFrame, limit: int = 10) -> DataFrame:
    return top(
        intelligence.where(F.col("expansion_level") == "High Expansion").select(
            "account_id",
            "company_name",
            "expansion_level",
            "computed_expansion_score",
            "computed_churn_risk_score",
            "recommended_action_type",
            "suggested_owner_role",
            "open_pipeline_value",
        ),
        [F.col(S.EXPANSION).desc(), F.col("account_id").asc()],
        limit,
    )


def top_review(intelligence: DataFrame, limit: int = 10) -> DataFrame:
    return top(
        intelligence.where("needs_human_review").select(
            "account_id",
            "company_name",
            "recommended_action_priority",
            "risk_level",
            "needs_human_review",
            "human_review_reason",
            "days_until_renewal",
        ),
        [
            F.expr(by_value("recommended_action_priority", PRIORITY_RANK, 4)).asc(),
            F.col("account_id").asc(),
        ],
        limit,
    )
