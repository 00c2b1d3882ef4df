"""Search, presets, urgency queues and summaries for exploring a portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.rules import Bands, aliased, by_bands, by_value, first_match, sql
from tallyscope.functions.text import whole_json
from tallyscope.operators import scoring as S
from tallyscope.operators.intelligence import MOTIONS
from tallyscope.operators.queues import priority_order, top
from tallyscope.operators.rollups import AT_RISK, RISK_ORDER, place_in

SEARCHED = (
    "company_name",
    "industry",
    "segment",
    "plan_type",
    "account_owner",
    "primary_business_motion",
    "risk_level",
    "expansion_level",
    "recommended_action_type",
    "recommended_next_action",
    "suggested_owner_role",
    "recommendation_reason",
)

# Urgency points, preset thresholds and the display bands (label, tone).
PRIORITY_POINTS = {"Critical": 1000, "High": 500}
RISK_POINTS = {"Critical Risk": 200, "High Risk": 100}
REVIEW_POINTS = 50
DISPLAY_BANDS = {
    "health": (
        S.HEALTH,
        (
            (75, "Healthy", "success"),
            (70, "Stable", "success"),
            (55, "Moderate", "warning"),
            (45, "Needs attention", "warning"),
        ),
        ("Unhealthy", "critical"),
    ),
    "churn": (
        S.CHURN,
        ((55, "Critical", "critical"), (40, "High", "warning"), (25, "Moderate", "warning")),
        ("Low", "success"),
    ),
    "expansion": (
        S.EXPANSION,
        (
            (70, "Strong fit", "success"),
            (45, "Moderate fit", "warning"),
            (40, "Emerging fit", "neutral"),
        ),
        ("Low fit", "neutral"),
    ),
}
TONE_WORDS = (("success", ("expand",)), ("warning", ("churn", "save", "recover")))


def urgency_score() -> Column:
    priority = by_value("recommended_action_priority", PRIORITY_POINTS, 0)
    risk = by_value("risk_level", RISK_POINTS, 0)
    review = f"IF(needs_human_review, {REVIEW_POINTS}, 0)"
    return F.expr(f"CAST({priority} + {risk} + {review} + {S.CHURN} AS DECIMAL(8,2))")


def with_urgency(intelligence: DataFrame) -> DataFrame:
    return intelligence.withColumn("urgency_score", urgency_score())


def _urgency_order() -> list[Column]:
    return [F.col("urgency_score").desc(), *priority_order()]


def account_search(intelligence: DataFrame, term: str) -> DataFrame:
    """Rows with the term inside any searched field, ignoring case; a blank term keeps all."""
    wanted = term.strip().lower()
    if not wanted:
        return intelligence
    hits = [f"coalesce(contains(lower({name}), {sql(wanted)}), FALSE)" for name in SEARCHED]
    return intelligence.where(" OR ".join(hits))


def priority_queue(intelligence: DataFrame, term: str = "", limit: int = 5) -> DataFrame:
    return top(with_urgency(account_search(intelligence, term)), _urgency_order(), limit)


def motion_summary(intelligence: DataFrame) -> DataFrame:
    return (
        intelligence.groupBy("primary_business_motion")
        .agg(
            F.count(F.lit(1)).alias("account_count"),
            F.sum("annual_recurring_revenue").alias("total_arr"),
        )
        .orderBy(place_in("primary_business_motion", MOTIONS))
    )


def preset_conditions() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "critical-risk": F.col("risk_level") == "Critical Risk",
        "high-risk": F.col("risk_level") == "High Risk",
        "expansion-ready": F.col(S.EXPANSION) >= 60,
        "human-review": F.col("needs_human_review"),
        "renewal-soon": F.col(S.RENEWAL) <= 60,
    }


def preset_filter(
    intelligence: DataFrame, preset: str = "all", term: str = "", limit: int | None = None
) -> DataFrame:
    """Preset, then search, then the first rows in priority order (all of them without a limit).

    The columns are the same with and without a limit; ``queues.top`` adds positions where wanted.
    """
    conditions = preset_conditions()
    if preset not in conditions:
        raise ValueError(f"unknown preset {preset!r}, expected one of {', '.join(conditions)}")
    found = account_search(intelligence.where(conditions[preset]), term)
    ordered = found.orderBy(*priority_order())
    return ordered if limit is None else ordered.limit(limit)


def preset_counts(intelligence: DataFrame) -> DataFrame:
    return intelligence.agg(
        *[
            F.count_if(condition).alias(name.replace("-", "_"))
            for name, condition in preset_conditions().items()
        ]
    )


def risk_totals(risk_summary: DataFrame) -> DataFrame:
    """Accounts per risk level, their sum, and how many are at critical or high risk."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at_risk = F.when(F.col("risk_level").isin(*AT_RISK), F.col("account_count")).otherwise(0)
    return (
        risk_summary.where(F.col("risk_level").isin(*RISK_ORDER))
        .select(
            "risk_level",
            "account_count",
            F.sum("account_count").over(whole).alias("total_accounts"),
            F.sum(at_risk).over(whole).alias("critical_and_high_accounts"),
        )
        .orderBy(place_in("risk_level", RISK_ORDER))
    )


def _tone(label: str) -> Column:
    tones = [(f"contains(lower({label}), '{w}')", tone) for tone, ws in TONE_WORDS for w in ws]
    return F.expr(first_match(tones, "neutral"))


def action_mix(action_summary: DataFrame, limit: int = 5) -> DataFrame:
    """The action types with most accounts; every row repeats the urgent-account total."""
    by_type = action_summary.groupBy("recommended_action_type").agg(
        F.sum("account_count").alias("account_count"),
        F.min(place_in("recommended_action_priority", ("Critical", "High", "Medium", "Low"))).alias(
            "__priority"
        ),
        F.sum(
            F.when(
                F.col("recommended_action_priority").isin("Critical", "High"),
                F.col("account_count"),
            ).otherwise(0)
        ).alias("__urgent"),
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = by_type.withColumn("high_priority_accounts", F.sum("__urgent").over(whole))
    order = [
        F.col("account_count").desc(),
        F.col("__priority").asc_nulls_last(),
        F.col("recommended_action_type").asc(),
    ]
    return top(counted, order, limit).select(
        "position",
        "recommended_action_type",
        "account_count",
        _tone("recommended_action_type").alias("tone"),
        "high_priority_accounts",
    )


def risk_queue(intelligence: DataFrame) -> DataFrame:
    risky = intelligence.where(F.col("risk_level").isin(*AT_RISK))
    return with_urgency(risky).orderBy(*_urgency_order())


def risk_queue_totals(intelligence: DataFrame) -> DataFrame:
    critical, high = (F.count_if(F.col("risk_level") == level) for level in AT_RISK)
    return intelligence.where(F.col("risk_level").isin(*AT_RISK)).agg(
        F.sum("annual_recurring_revenue").alias("arr_at_risk"),
        critical.alias("critical_accounts"),
        high.alias("high_accounts"),
    )


def _growing() -> Column:
    return (F.col("primary_business_motion") == "Expand") | (F.col(S.EXPANSION) >= 60)


def expansion_queue(intelligence: DataFrame) -> DataFrame:
    return intelligence.where(_growing()).orderBy(
        F.col(S.EXPANSION).desc_nulls_first(), *priority_order()
    )


def expansion_queue_totals(intelligence: DataFrame) -> DataFrame:
    return intelligence.where(_growing()).agg(
        F.count(F.lit(1)).alias("account_count"),
        F.sum("annual_recurring_revenue").alias("total_arr"),
    )


def review_queue(intelligence: DataFrame) -> DataFrame:
    return with_urgency(intelligence.where("needs_human_review")).orderBy(*_urgency_order())


def display_bands(intelligence: DataFrame) -> DataFrame:
    columns = {}
    for name, (source, rungs, default) in DISPLAY_BANDS.items():
        for part, kind in enumerate(("label", "tone")):
            bands = Bands(source, tuple((">=", r[0], r[1 + part]) for r in rungs), default[part])
            columns[f"{name}_{kind}"] = by_bands(bands)
    return intelligence.selectExpr(
        "account_id", S.HEALTH, S.CHURN, S.EXPANSION, *aliased(columns)
    )


def steps_from_json(text: Column) -> Column:
    """A list from its JSON text; any other text becomes a one-entry list, nothing an empty list.

    The whole text has to be a JSON list; a JSON string is the one entry it holds.
    """
    parsed = whole_json(text)
    listed = F.try_variant_get(parsed, "$", "array<string>")
    kind = F.schema_of_variant(parsed)
    entry = F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(text)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
        F.coalesce(listed, F.array(entry))
    )
