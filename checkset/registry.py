"""Every operator as a query over the test tables, with portable column types."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkset.fixture import AS_OF, base_tables
from tallyscope.operators import explain, explore, quality, queues, rollups, scoring
from tallyscope.operators.playbook import playbook_signals, playbook_steps, signals
from tallyscope.operators.search_index import indexed_search, search_index
from tallyscope.operators.usage_days import UsageDays
from tallyscope.plans.portfolio import Portfolio

Query = Callable[[SparkSession, str], DataFrame]

LIST_SEPARATOR = " | "
NULL_ENTRY = "<null>"


def _portable_column(field: T.StructField) -> str:
    name, kind = field.name, field.dataType
    if isinstance(kind, T.DecimalType):
        return f"CAST({name} AS DOUBLE) AS {name}"
    if isinstance(kind, T.IntegerType):
        return f"CAST({name} AS BIGINT) AS {name}"
    if isinstance(kind, T.DateType):
        return f"CAST({name} AS STRING) AS {name}"
    if isinstance(kind, T.TimestampNTZType):
        return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') AS {name}"
    if isinstance(kind, T.ArrayType):
        return f"array_join({name}, '{LIST_SEPARATOR}', '{NULL_ENTRY}') AS {name}"
    return f"`{name}`"


def portable(df: DataFrame) -> DataFrame:
    """Types whose values look the same in every engine: money as double, dates as text."""
    return df.selectExpr(*[_portable_column(field) for field in df.schema.fields])


SEARCH_TERM = " Renewal "
MOTION = "Recover"
ACCOUNT_ID = "5"
PRESET = "renewal-soon"
PRESET_TERM = "enterprise"
PRESET_LIMIT = 25
DAYS_BACK = (0, 7, 45)
# Counts of the sf0.01 tables; other sizes give warnings, as the check intends.
EXPECTED_ROWS = {
    "accounts": 1500,
    "product_usage_events": 70000,
    "customer_engagement": 1500,
    "crm_opportunities": 15000,
    "score_history": 15000,
    "actions": 15000,
    "experiments": 2000,
    "system_logs": 9999,
}

COMPONENTS = tuple(scoring.COMPONENT_BANDS)
SCORES = (scoring.HEALTH, scoring.CHURN, "raw_expansion_score", scoring.EXPANSION)
def stored_responses(intelligence: DataFrame) -> DataFrame:
    """Answers in the stored JSON format, built from the accounts' own values.

    Accounts without an NPS get a refusal in plain text, those without a renewal date a bare list.
    """

    def driver(signal: str, column: str, *more: Column) -> Column:
        fields = [F.lit(signal).alias("signal"), F.col(column).alias("value"), *more]
        return F.to_json(F.struct(*fields))

    drivers = F.concat(
        F.lit('"key_signal_drivers":['),
        driver("Usage", "usage_events_last_30_days", F.col("churn_status").alias("interpretation")),
        F.lit(',"stray text",'),
        driver("NPS", "nps_score"),
        F.lit(","),
        driver("Review", "needs_human_review", F.col("risk_level").alias("interpretation")),
        F.lit("]"),
    )
    texts = F.to_json(
        F.struct(
            F.col("ai_explanation_context").alias("ai_summary"),
            F.col("health_status").alias("account_status_explanation"),
            F.col("recommended_next_action").alias("recommended_next_step"),
            F.col("timeline_label").alias("confidence_note"),
        )
    )
    body = F.concat(F.expr("left(texts, length(texts) - 1)"), F.lit(","), drivers, F.lit("}"))
    return intelligence.withColumn("texts", texts).select(
        "account_id",
        F.when(F.col("nps_score").isNull(), F.concat(F.lit("no answer for "), "account_id"))
        .when(F.col("days_until_renewal").isNull(), F.concat(F.lit("["), "account_id", F.lit("]")))
        .otherwise(body)
        .alias("response_json"),
    )


def parsed_responses(intelligence: DataFrame) -> DataFrame:
    parsed = explain.parse_explanations(stored_responses(intelligence))
    return parsed.withColumn(
        "key_signal_drivers",
        F.transform(
            "key_signal_drivers",
            lambda d: F.concat_ws("=", d["signal"], d["value"], d["interpretation"]),
        ),
    )


def steps_from_json(intelligence: DataFrame) -> DataFrame:
    """Lists as JSON; accounts without owner give nothing, those without renewal plain text."""
    stored = (
        F.when(F.col("account_owner").isNull(), F.lit(""))
        .when(F.col("days_until_renewal").isNull(), F.col("timeline_label"))
        .otherwise(F.to_json("phase_2_next_steps"))
    )
    steps = explore.steps_from_json(F.col("stored"))
    return intelligence.select("account_id", stored.alias("stored")).select(
        "account_id", F.size(steps).alias("step_count"), steps.alias("steps")
    )


def _full(p: Portfolio, chosen: DataFrame) -> DataFrame:
    """Rows chosen and sorted by their labels, with the texts added after the sort."""
    return p.with_texts(chosen)


def _spark(p: Portfolio) -> SparkSession:
    return p.tables["accounts"].sparkSession


def _usage_days(p: Portfolio) -> UsageDays:
    return UsageDays.of(p.tables["product_usage_events"])


def _labels(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("account_id", *columns)


RELATIONS: dict[str, Callable[[Portfolio], DataFrame]] = {
    "action_features": lambda p: p.action_features,
    "engagement_features": lambda p: p.engagement_features,
    "opportunity_features": lambda p: p.opportunity_features,
    "latest_score": lambda p: p.score_features,
    "usage_features": lambda p: p.usage_features,
    "usage_from_days": lambda p: _usage_days(p).usage_features(AS_OF),
    "usage_over_dates": lambda p: _usage_days(p).usage_features_over(
        [AS_OF - timedelta(days=days) for days in DAYS_BACK]
    ),
    "account_features": lambda p: p.account_features,
    "component_scores": lambda p: _labels(p.scoring_v1, *COMPONENTS),
    "composite_scores": lambda p: _labels(p.scoring_v1, *SCORES),
    "scoring_v1": lambda p: p.scoring_v1,
    "scoring_v2": lambda p: p.scoring_v2,
    "scoring_v3": lambda p: p.scoring_v3,
    "recommended_actions": lambda p: p.recommended,
    "playbook_signals": lambda p: _labels(playbook_signals(p.recommended), *signals()),
    "playbook_timeline": lambda p: _labels(
        p.playbook, "recommended_action_type", "timeline_label", "playbook_version"
    ),
    "playbook_steps": lambda p: playbook_steps(p.playbook),
    "playbook_lists": lambda p: _labels(p.playbook, "phase_2_next_steps", "success_metrics"),
    "playbook_escalation": lambda p: _labels(p.playbook, "account_name", "escalation_guidance"),
    "intelligence": lambda p: p.intelligence,
    "dashboard_kpis": lambda p: rollups.dashboard_kpis(p.intelligence),
    "risk_summary": lambda p: rollups.risk_summary(p.intelligence),
    "action_summary": lambda p: rollups.action_summary(p.intelligence),
    "owner_workload": lambda p: rollups.owner_workload(p.intelligence),
    **{
        f"{name}_unfolded": lambda p, name=name: rollups.unfolded(rollups.all_rollups(p.intelligence))[name]
        for name in ("dashboard_kpis", "risk_summary", "action_summary", "owner_workload")
    },
    "accounts_ranked": lambda p: queues.listed(p.with_texts(queues.accounts_ranked(p.labels))),
    "high_risk": lambda p: _full(p, queues.high_risk(p.labels)),
    "expansion_ready": lambda p: _full(p, queues.expansion_ready(p.labels)),
    "review_needed": lambda p: _full(p, queues.review_needed(p.labels)),
    "by_motion": lambda p: _full(p, queues.by_motion(p.labels, MOTION)),
    "account_by_id": lambda p: queues.account_by_id(p.intelligence, ACCOUNT_ID),
    "row_counts": lambda p: quality.row_counts(p.tables).unionByName(
        quality.derived_row_counts(p.recommended)
    ),
    "pk_check": lambda p: quality.primary_keys(_spark(p), p.tables),
    "fk_orphans": lambda p: quality.foreign_key_orphans(_spark(p), p.tables),
    "not_null": lambda p: quality.not_null(_spark(p), p.tables),
    "critical_nulls": lambda p: quality.critical_nulls(_spark(p), p.tables),
    "quality_summary": lambda p: quality.quality_summary(
        quality.quality_report(_spark(p), p.tables, EXPECTED_ROWS)
    ),
    "duplicate_accounts": lambda p: quality.duplicate_accounts(p.tables["accounts"]),
    "missing_accounts": lambda p: quality.missing_accounts(p.tables["accounts"], p.intelligence),
    "playbook_gaps": lambda p: quality.playbook_gaps(p.intelligence),
    "score_range": lambda p: quality.score_range(p.intelligence),
    "scores_out_of_range": lambda p: quality.scores_out_of_range(p.intelligence),
    "kpi_subset": lambda p: quality.kpi_subset(rollups.dashboard_kpis(p.intelligence)),
    "risk_subset": lambda p: quality.risk_subset(rollups.risk_summary(p.intelligence)),
    "top10_risk": lambda p: queues.top_high_risk(p.intelligence),
    "top10_expansion": lambda p: queues.top_expansion(p.intelligence),
    "top10_review": lambda p: queues.top_review(p.intelligence),
    "owner_subset": lambda p: quality.owner_subset(rollups.owner_workload(p.intelligence)),
    "motion_distribution": lambda p: rollups.motion_distribution(p.intelligence),
    "account_search": lambda p: _full(p, explore.account_search(p.labels, SEARCH_TERM)),
    "account_search_indexed": lambda p: _full(
        p, indexed_search(p.labels, search_index(p.labels), SEARCH_TERM)
    ),
    "priority_queue": lambda p: _full(p, explore.priority_queue(p.labels, PRESET_TERM)),
    "motion_summary": lambda p: explore.motion_summary(p.intelligence),
    "preset_filter": lambda p: _full(
        p, explore.preset_filter(p.labels, PRESET, PRESET_TERM, PRESET_LIMIT)
    ),
    "preset_counts": lambda p: explore.preset_counts(p.intelligence),
    "risk_totals": lambda p: explore.risk_totals(rollups.risk_summary(p.intelligence)),
    "action_mix": lambda p: explore.action_mix(rollups.action_summary(p.intelligence)),
    "risk_queue": lambda p: _full(p, explore.risk_queue(p.labels)),
    "risk_queue_totals": lambda p: explore.risk_queue_totals(p.intelligence),
    "expansion_queue": lambda p: _full(p, explore.expansion_queue(p.labels)),
    "expansion_queue_totals": lambda p: explore.expansion_queue_totals(p.intelligence),
    "review_queue": lambda p: _full(p, explore.review_queue(p.labels)),
    "display_bands": lambda p: explore.display_bands(p.intelligence),
    "steps_from_json": lambda p: steps_from_json(p.intelligence),
    "explanation_context": lambda p: explain.explanation_context(p.intelligence),
    "explanation_parse": lambda p: parsed_responses(p.intelligence),
}


def portfolio(spark: SparkSession, sf_dir: str) -> Portfolio:
    return Portfolio(base_tables(spark, sf_dir), AS_OF)


def _query(relation: Callable[[Portfolio], DataFrame]) -> Query:
    return lambda spark, sf_dir: portable(relation(portfolio(spark, sf_dir)))


QUERIES: dict[str, Query] = {name: _query(relation) for name, relation in RELATIONS.items()}
