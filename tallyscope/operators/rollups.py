"""Portfolio roll-ups over the intelligence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.numbers import average
from tallyscope.functions.rules import by_value
from tallyscope.operators import scoring as S

# Severity orders and version stamps.
RISK_ORDER = ("Critical Risk", "High Risk", "Moderate Risk", "Low Risk")
PRIORITY_ORDER = ("Critical", "High", "Medium", "Low")
AT_RISK = ("Critical Risk", "High Risk")


def place_in(column: str, order: tuple[str, ...]) -> Column:
    return F.expr(by_value(column, {name: n for n, name in enumerate(order, 1)}, None))


def _rows() -> Column:
    return F.count(F.lit(1))


def _reviews() -> Column:
    return F.count_if(F.col("needs_human_review"))


def _averages(*scores: str) -> list[Column]:
    names = {
        S.HEALTH: "avg_health_score",
        S.CHURN: "avg_churn_risk_score",
        S.EXPANSION: "avg_expansion_score",
    }
    return [average(score).cast(S.SCORE_TYPE).alias(names[score]) for score in scores]


def _risk_order() -> list[Column]:
    return [place_in("risk_level", RISK_ORDER).asc_nulls_last()]


def _action_order() -> list[Column]:
    return [
        place_in("recommended_action_priority", PRIORITY_ORDER).asc_nulls_last(),
        F.col("account_count").desc(),
        F.col("recommended_action_type"),
    ]


def _owner_order() -> list[Column]:
    names = ("critical_action_count", "high_action_count", "human_review_count", "assigned_account_count")
    return [*[F.col(name).desc() for name in names], F.col("suggested_owner_role")]


def dashboard_kpis(intelligence: DataFrame) -> DataFrame:
    def having(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    arr, pipeline = F.col("annual_recurring_revenue"), F.col("open_pipeline_value")
    return intelligence.agg(
        _rows().alias("total_accounts"),
        having("risk_level", "Critical Risk").alias("critical_risk_accounts"),
        having("risk_level", "High Risk").alias("high_risk_accounts"),
        having("expansion_level", "High Expansion").alias("high_expansion_accounts"),
        _reviews().alias("accounts_needing_human_review"),
        *[
            having("primary_business_motion", motion).alias(f"{motion.lower()}_motion_accounts")
            for motion in ("Save", "Recover", "Renewal", "Expand")
        ],
        *_averages(S.HEALTH, S.CHURN, S.EXPANSION),
        F.sum(arr).alias("total_arr"),
        F.sum(F.when(F.col("risk_level").isin(*AT_RISK), arr)).alias("arr_at_risk"),
        F.sum(pipeline).alias("total_open_pipeline"),
        F.sum(F.when(F.col("expansion_level") == "High Expansion", pipeline)).alias(
            "high_expansion_pipeline"
        ),
        F.lit("phase_15_v1_dashboard_kpis").alias("dashboard_kpi_version"),
    )


def risk_summary(intelligence: DataFrame) -> DataFrame:
    return (
        intelligence.groupBy("risk_level")
        .agg(
            _rows().alias("account_count"),
            *_averages(S.HEALTH, S.CHURN, S.EXPANSION),
            F.sum("annual_recurring_revenue").alias("total_arr"),
            F.sum("open_pipeline_value").alias("total_open_pipeline"),
            _reviews().alias("accounts_needing_human_review"),
            F.lit("phase_15_v1_dashboard_risk_summary").alias("dashboard_risk_summary_version"),
        )
        .orderBy(*_risk_order())
    )


def action_summary(intelligence: DataFrame) -> DataFrame:
    return (
        intelligence.groupBy("recommended_action_priority", "recommended_action_type")
        .agg(
            _rows().alias("account_count"),
            _reviews().alias("accounts_needing_human_review"),
            F.min("recommended_due_date").alias("earliest_due_date"),
            F.max("recommended_due_date").alias("latest_due_date"),
            *_averages(S.CHURN, S.EXPANSION),
            F.sum("annual_recurring_revenue").alias("total_arr"),
            F.sum("open_pipeline_value").alias("total_open_pipeline"),
            F.lit("phase_15_v1_dashboard_action_summary").alias("dashboard_action_summary_version"),
        )
        .orderBy(*_action_order())
    )


def owner_workload(intelligence: DataFrame) -> DataFrame:
    return (
        intelligence.groupBy("suggested_owner_role")
        .agg(
            _rows().alias("assigned_account_count"),
            *[
                F.count_if(F.col("recommended_action_priority") == priority).alias(
                    f"{priority.lower()}_action_count"
                )
                for priority in PRIORITY_ORDER
            ],
            _reviews().alias("human_review_count"),
            *_averages(S.HEALTH, S.CHURN, S.EXPANSION),
            F.sum("annual_recurring_revenue").alias("total_arr_owned"),
            F.sum("open_pipeline_value").alias("total_pipeline_owned"),
            F.lit("phase_15_v1_dashboard_owner_workload").alias("dashboard_owner_workload_version"),
        )
        .orderBy(*_owner_order())
    )


def motion_distribution(intelligence: DataFrame) -> DataFrame:
    return (
        intelligence.groupBy("primary_business_motion")
        .agg(
            _rows().alias("account_count"),
            average(S.CHURN).cast(S.SCORE_TYPE).alias("avg_churn"),
            F.sum("annual_recurring_revenue").alias("total_arr"),
        )
        .orderBy(F.col("account_count").desc(), "primary_business_motion")
    )


#: Grouping sets of ``all_rollups``: keys, and the grouping id that marks their rows.
_SET_KEYS = (
    "risk_level",
    "recommended_action_priority",
    "recommended_action_type",
    "suggested_owner_role",
)
_TOTAL, _BY_RISK, _BY_ACTION, _BY_OWNER = 0b1111, 0b0111, 0b1001, 0b1110


def all_rollups(intelligence: DataFrame) -> DataFrame:
    """The measures of the four dashboards for every group of each, from one pass over the rows.

    A row goes to four grouping sets (all, risk level, action, owner role) and is combined per task, so
    one small shuffle carries what four scans and four shuffles would. ``unfolded`` reads the
    dashboards off; write the result once where several of them are wanted.
    """
    arr, pipeline = F.col("annual_recurring_revenue"), F.col("open_pipeline_value")

    def having(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    sets = [
        [],
        ["risk_level"],
        ["recommended_action_priority", "recommended_action_type"],
        ["suggested_owner_role"],
    ]
    return intelligence.groupingSets([[F.col(c) for c in keys] for keys in sets], *_SET_KEYS).agg(
        F.grouping_id().cast("int").alias("grouping_set"),
        _rows().alias("rows"),
        _reviews().alias("reviews"),
        *[having("risk_level", level).alias(f"{level.split()[0].lower()}_risk") for level in AT_RISK],
        having("expansion_level", "High Expansion").alias("high_expansion"),
        *[
            having("primary_business_motion", motion).alias(f"{motion.lower()}_motion")
            for motion in ("Save", "Recover", "Renewal", "Expand")
        ],
        *[
            having("recommended_action_priority", priority).alias(f"{priority.lower()}_actions")
            for priority in PRIORITY_ORDER
        ],
        *_averages(S.HEALTH, S.CHURN, S.EXPANSION),
        F.sum(arr).alias("arr"),
        F.sum(F.when(F.col("risk_level").isin(*AT_RISK), arr)).alias("arr_at_risk"),
        F.sum(pipeline).alias("pipeline"),
        F.sum(F.when(F.col("expansion_level") == "High Expansion", pipeline)).alias("high_expansion_pipeline"),
        F.min("recommended_due_date").alias("earliest_due_date"),
        F.max("recommended_due_date").alias("latest_due_date"),
    )


def unfolded(rollups: DataFrame) -> dict[str, DataFrame]:
    """The four dashboards, as their own functions return them, from ``all_rollups``."""

    def rows(grouping_set: int) -> DataFrame:
        return rollups.where(F.col("grouping_set") == grouping_set)

    averages = ["avg_health_score", "avg_churn_risk_score", "avg_expansion_score"]
    counts = {
        "rows": "total_accounts",
        "critical_risk": "critical_risk_accounts",
        "high_risk": "high_risk_accounts",
        "high_expansion": "high_expansion_accounts",
        "reviews": "accounts_needing_human_review",
        **{f"{m}_motion": f"{m}_motion_accounts" for m in ("save", "recover", "renewal", "expand")},
    }
    money = {
        "arr": "total_arr",
        "arr_at_risk": "arr_at_risk",
        "pipeline": "total_open_pipeline",
        "high_expansion_pipeline": "high_expansion_pipeline",
    }
    # an aggregate over one row at most: without accounts there is a row of zeros all the same
    kpis = rows(_TOTAL).agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(name) for c, name in counts.items()],
        *[F.max(c).alias(c) for c in averages],
        *[F.max(c).alias(name) for c, name in money.items()],
        F.lit("phase_15_v1_dashboard_kpis").alias("dashboard_kpi_version"),
    )
    risks = rows(_BY_RISK).select(
        "risk_level",
        F.col("rows").alias("account_count"),
        *averages,
        F.col("arr").alias("total_arr"),
        F.col("pipeline").alias("total_open_pipeline"),
        F.col("reviews").alias("accounts_needing_human_review"),
        F.lit("phase_15_v1_dashboard_risk_summary").alias("dashboard_risk_summary_version"),
    )
    actions = rows(_BY_ACTION).select(
        "recommended_action_priority",
        "recommended_action_type",
        F.col("rows").alias("account_count"),
        F.col("reviews").alias("accounts_needing_human_review"),
        "earliest_due_date",
        "latest_due_date",
        *averages[1:],
        F.col("arr").alias("total_arr"),
        F.col("pipeline").alias("total_open_pipeline"),
        F.lit("phase_15_v1_dashboard_action_summary").alias("dashboard_action_summary_version"),
    )
    owners = rows(_BY_OWNER).select(
        "suggested_owner_role",
        F.col("rows").alias("assigned_account_count"),
        *[F.col(f"{p.lower()}_actions").alias(f"{p.lower()}_action_count") for p in PRIORITY_ORDER],
        F.col("reviews").alias("human_review_count"),
        *averages,
        F.col("arr").alias("total_arr_owned"),
        F.col("pipeline").alias("total_pipeline_owned"),
        F.lit("phase_15_v1_dashboard_owner_workload").alias("dashboard_owner_workload_version"),
    )
    return {
        "dashboard_kpis": kpis,
        "risk_summary": risks.orderBy(*_risk_order()),
        "action_summary": actions.orderBy(*_action_order()),
        "owner_workload": owners.orderBy(*_owner_order()),
    }
