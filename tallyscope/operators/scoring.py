"""Banded component scores, weighted composite scores and the three label models."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame

from tallyscope.functions.binding import bind_once, with_sql
from tallyscope.functions.rules import Bands, Cond, Rule, Sql, by_bands, by_rules, first_match

# Thresholds and points of the component bands. A NULL signal takes the default.
COMPONENT_BANDS = {
    "usage_activity_score": Bands(
        "usage_events_last_30_days",
        ((">=", 120, 100), (">=", 80, 85), (">=", 50, 70), (">=", 25, 45)),
        20,
    ),
    "active_user_score": Bands(
        "active_users_last_30_days",
        ((">=", 60, 100), (">=", 35, 85), (">=", 20, 70), (">=", 10, 45)),
        20,
    ),
    "nps_score_component": Bands(
        "nps_score", ((">=", 9, 100), (">=", 7, 80), (">=", 5, 55), (">=", 3, 30)), 10
    ),
    "engagement_recency_score": Bands(
        "days_since_last_touch", (("<=", 7, 100), ("<=", 14, 80), ("<=", 30, 60), ("<=", 60, 35)), 10
    ),
    "support_health_score": Bands(
        "support_tickets_last_30_days", (("=", 0, 100), ("<=", 2, 85), ("<=", 4, 65), ("<=", 7, 35)), 10
    ),
    "action_discipline_score": Bands(
        "overdue_action_count", (("=", 0, 100), ("=", 1, 75), ("=", 2, 50), ("<=", 4, 25)), 5
    ),
    "renewal_risk_score": Bands(
        "days_until_renewal", (("<=", 30, 100), ("<=", 60, 80), ("<=", 90, 60), ("<=", 180, 35)), 15
    ),
    "pipeline_value_score": Bands(
        "open_pipeline_value", ((">=", 250000, 100), (">=", 100000, 80), (">=", 50000, 60), (">", 0, 40)), 10
    ),
    "expansion_signal_score": Bands(
        "expansion_opportunity_count", ((">=", 3, 100), (">=", 2, 80), ("=", 1, 55)), 10
    ),
}

# Weights of the composite scores in percent. Churn risk counts the missing
# points (100 - component) of everything but renewal risk.
HEALTH_WEIGHTS = {
    "usage_activity_score": 25,
    "active_user_score": 20,
    "nps_score_component": 20,
    "engagement_recency_score": 15,
    "support_health_score": 10,
    "action_discipline_score": 10,
}
CHURN_WEIGHTS = {
    "usage_activity_score": 20,
    "active_user_score": 15,
    "nps_score_component": 20,
    "support_health_score": 15,
    "renewal_risk_score": 15,
    "action_discipline_score": 15,
}
RISING_WITH_CHURN = {"renewal_risk_score"}
EXPANSION_WEIGHTS = {
    "usage_activity_score": 25,
    "active_user_score": 20,
    "nps_score_component": 20,
    "pipeline_value_score": 20,
    "expansion_signal_score": 15,
}
# Churn risk from which the raw expansion score is multiplied down.
EXPANSION_DAMPING = ((70, Decimal("0.65")), (55, Decimal("0.85")))

HEALTH = "computed_health_score"
CHURN = "computed_churn_risk_score"
EXPANSION = "computed_expansion_score"
RENEWAL = "days_until_renewal"
SCORE_TYPE = "DECIMAL(5,2)"

# Label names and thresholds.
EXPANSION_LEVELS = Bands(
    EXPANSION, ((">=", 75, "High Expansion"), (">=", 50, "Medium Expansion")), "Low Expansion"
)
SAVE_IMMEDIATELY = "Tier 1 - Save Immediately"
CHURN_INTERVENTION = "Tier 1 - Churn Intervention"
RENEWAL_RISK_WATCH = "Tier 2 - Renewal Risk Watch"
CHURN_RISK_WATCH = "Tier 2 - Churn Risk Watch"
RENEWAL_REVIEW = "Tier 2 - Renewal Review"
RENEWAL_EXPANSION_REVIEW = "Tier 2 - Renewal Expansion Review"
EXPANSION_READY = "Tier 2 - Expansion Ready"
RENEWAL_MONITOR = "Tier 3 - Renewal Monitor"
EXPANSION_NURTURE = "Tier 3 - Expansion Nurture"
MAINTAIN = "Tier 3 - Maintain"
MONITOR = "Tier 4 - Monitor"


def _risk_levels(critical: int, high: int, moderate: int) -> Bands:
    return Bands(
        CHURN,
        (
            (">=", critical, "Critical Risk"),
            (">=", high, "High Risk"),
            (">=", moderate, "Moderate Risk"),
        ),
        "Low Risk",
    )


@dataclass(frozen=True)
class LabelModel:
    """Column names and rules of one version; ``None`` leaves a label to an earlier version."""

    tier_column: str
    tiers: tuple[Rule, ...]
    version_column: str
    version: str
    risk_column: str | None = None
    risk_levels: Bands | None = None
    expansion_column: str | None = None


_MAINTAIN_RULE = Rule(MAINTAIN, (Cond(HEALTH, ">=", 65), Cond(CHURN, "<", 40)))
_NURTURE_BELOW_55 = Rule(EXPANSION_NURTURE, (Cond(EXPANSION, ">=", 60), Cond(CHURN, "<", 55)))


def model_v1(as_of: date) -> LabelModel:
    return LabelModel(
        risk_column="risk_level",
        risk_levels=_risk_levels(75, 60, 40),
        expansion_column="expansion_level",
        tier_column="customer_priority_tier",
        tiers=(
            Rule(SAVE_IMMEDIATELY, (Cond(CHURN, ">=", 75), Cond(RENEWAL, "<=", 90))),
            Rule(CHURN_INTERVENTION, (Cond(CHURN, ">=", 75),)),
            Rule(RENEWAL_RISK_WATCH, (Cond(CHURN, ">=", 60), Cond(RENEWAL, "<=", 120))),
            Rule(EXPANSION_READY, (Cond(EXPANSION, ">=", 75), Cond(CHURN, "<", 50))),
            Rule(EXPANSION_NURTURE, (Cond(EXPANSION, ">=", 60), Cond(CHURN, "<", 60))),
            _MAINTAIN_RULE,
        ),
        version_column="scoring_model_version",
        version=f"phase_12_v1_fixed_reference_{as_of:%Y_%m_%d}",
    )


MODEL_V2 = LabelModel(
    risk_column="risk_level_v2",
    risk_levels=_risk_levels(60, 50, 40),
    expansion_column="expansion_level_v2",
    tier_column="customer_priority_tier_v2",
    tiers=(
        Rule(SAVE_IMMEDIATELY, (Cond(CHURN, ">=", 60), Cond(RENEWAL, "<=", 90))),
        Rule(CHURN_INTERVENTION, (Cond(CHURN, ">=", 60),)),
        Rule(RENEWAL_RISK_WATCH, (Cond(CHURN, ">=", 50), Cond(RENEWAL, "<=", 120))),
        Rule(CHURN_RISK_WATCH, (Cond(CHURN, ">=", 50),)),
        Rule(EXPANSION_READY, (Cond(EXPANSION, ">=", 75), Cond(CHURN, "<", 45))),
        _NURTURE_BELOW_55,
        _MAINTAIN_RULE,
    ),
    version_column="scoring_model_version_v2",
    version="phase_12_v2_adjusted_classification_thresholds",
)

MODEL_V3 = LabelModel(
    tier_column="customer_priority_tier_v3",
    tiers=(
        Rule(SAVE_IMMEDIATELY, (Cond(CHURN, ">=", 60), Cond(RENEWAL, "<=", 90))),
        Rule(CHURN_INTERVENTION, (Cond(CHURN, ">=", 60),)),
        Rule(RENEWAL_RISK_WATCH, (Cond(CHURN, ">=", 50), Cond(RENEWAL, "<=", 120))),
        Rule(CHURN_RISK_WATCH, (Cond(CHURN, ">=", 50),)),
        Rule(RENEWAL_REVIEW, (Cond(CHURN, ">=", 40), Cond(RENEWAL, "<=", 30))),
        Rule(RENEWAL_MONITOR, (Cond(CHURN, ">=", 40), Cond(RENEWAL, "<=", 60))),
        Rule(
            RENEWAL_EXPANSION_REVIEW,
            (Cond(EXPANSION, ">=", 75), Cond(RENEWAL, "<=", 60), Cond(CHURN, "<", 50)),
        ),
        Rule(EXPANSION_READY, (Cond(EXPANSION, ">=", 75), Cond(CHURN, "<", 50))),
        _NURTURE_BELOW_55,
        _MAINTAIN_RULE,
    ),
    version_column="scoring_model_version_v3",
    version="phase_12_v3_adjusted_priority_tier_logic",
)

SCORING_INPUTS = (
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
    "days_since_last_touch",
    "overdue_action_count",
    "open_pipeline_value",
    "expansion_opportunity_count",
    "latest_health_score",
    "latest_churn_score",
    "latest_expansion_score",
    "latest_score_reason",
    "latest_score_date",
)


def component_scores(features: DataFrame) -> DataFrame:
    return with_sql(
        features.select(*SCORING_INPUTS),
        {name: by_bands(bands) for name, bands in COMPONENT_BANDS.items()},
    )


def _weighted(weights: dict[str, int], missing_points: bool = False) -> Sql:
    def points(name: str) -> str:
        return f"(100 - {name})" if missing_points and name not in RISING_WITH_CHURN else name

    total = " + ".join(f"{weight} * {points(name)}" for name, weight in weights.items())
    return Sql(f"CAST(({total}) * 0.01 AS {SCORE_TYPE})")


def composite_scores(components: DataFrame) -> DataFrame:
    scored = bind_once(
        components,
        (*SCORING_INPUTS, *COMPONENT_BANDS),
        {
            HEALTH: _weighted(HEALTH_WEIGHTS),
            CHURN: _weighted(CHURN_WEIGHTS, missing_points=True),
            "raw_expansion_score": _weighted(EXPANSION_WEIGHTS),
        },
    )
    damped = [
        (
            f"{CHURN} >= {from_churn}",
            Sql(f"CAST(round(raw_expansion_score * {factor}, 2) AS {SCORE_TYPE})"),
        )
        for from_churn, factor in EXPANSION_DAMPING
    ]
    return with_sql(scored, {EXPANSION: first_match(damped, Sql("raw_expansion_score"))})


def label(scored: DataFrame, model: LabelModel) -> DataFrame:
    columns = {}
    if model.risk_levels:
        columns[model.risk_column] = by_bands(model.risk_levels)
    if model.expansion_column:
        columns[model.expansion_column] = by_bands(EXPANSION_LEVELS)
    columns[model.tier_column] = by_rules(model.tiers, MONITOR)
    columns[model.version_column] = model.version
    return with_sql(scored, columns)


def score_v1(features: DataFrame, as_of: date) -> DataFrame:
    return label(composite_scores(component_scores(features)), model_v1(as_of))


def score_v2(scored_v1: DataFrame) -> DataFrame:
    return label(scored_v1, MODEL_V2)


def score_v3(scored_v2: DataFrame) -> DataFrame:
    return label(scored_v2, MODEL_V3)
