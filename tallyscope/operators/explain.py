"""Explanation jobs: a context document per account, and reading stored JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.rules import Sql, sql
from tallyscope.functions.text import as_text, whole_json

MISSING = "—"

# Headings, field names with their padded width, and the blocks of the document.
# Columns are (heading, width, ((name, column, bracketed column), ...)).
TITLE = "ACCOUNT CONTEXT (pre-computed by PostgreSQL scoring and action playbook engine):"
FIELD_BLOCKS = (
    (
        "ACCOUNT PROFILE:",
        20,
        (
            ("Company:", "company_name", None),
            ("Industry:", "industry", None),
            ("Segment:", "segment", None),
            ("Plan Type:", "plan_type", None),
            ("Account Owner:", "account_owner", None),
            ("Days Until Renewal:", "days_until_renewal", None),
        ),
    ),
    (
        "COMPUTED SCORES (ground truth — do not recalculate):",
        23,
        (
            ("Health Score:", "computed_health_score", "health_status"),
            ("Churn Risk Score:", "computed_churn_risk_score", "churn_status"),
            ("Expansion Score:", "computed_expansion_score", "expansion_status"),
        ),
    ),
    (
        "CLASSIFICATION (ground truth — do not override):",
        23,
        (
            ("Risk Level:", "risk_level", None),
            ("Expansion Level:", "expansion_level", None),
            ("Priority Tier:", "customer_priority_tier", None),
            ("Business Motion:", "primary_business_motion", None),
        ),
    ),
    (
        "BEHAVIORAL SIGNALS (last 30 days):",
        23,
        (
            ("Usage Events:", "usage_events_last_30_days", None),
            ("Active Users:", "active_users_last_30_days", None),
            ("Support Tickets:", "support_tickets_last_30_days", None),
            ("NPS Score:", "nps_score", None),
            ("Overdue Actions:", "overdue_action_count", None),
        ),
    ),
    (
        "DETERMINISTIC ACTION PLAN (do not alter — explain why this plan fits the signals above):",
        23,
        (
            ("Action Type:", "recommended_action_type", None),
            ("Priority:", "recommended_action_priority", None),
            ("Suggested Owner:", "suggested_owner_role", None),
            ("Due Date:", "recommended_due_date", None),
            ("Timeline:", "timeline_label", None),
            ("Recommendation Reason:", "recommendation_reason", None),
        ),
    ),
)
REVIEW_FLAG = "  Human Review Required: "
REVIEW_REASON = "  Review Reason:         "
TEXT_BLOCKS = {
    "recommended_next_action": "NEXT ACTION (pre-determined — do not replace):",
    "escalation_guidance": "ESCALATION GUIDANCE (pre-determined):",
}
LIST_BLOCKS = {
    "immediate_next_steps": "IMMEDIATE STEPS (pre-determined — explain why these fit the signals, do not invent alternatives):",
    "phase_2_next_steps": "PHASE 2 FOLLOW-UP STEPS (pre-determined):",
    "success_metrics": "SUCCESS METRICS (pre-determined — explain what each measures and why it matters):",
}


def _given(column: str) -> Sql:
    return Sql(f"nullif({as_text(column)}, '')")


def _shown(column: str) -> Sql:
    return Sql(f"coalesce({_given(column)}, {sql(MISSING)})")


def _field_line(name: str, width: int, column: str, bracketed: str | None) -> Sql:
    parts = [sql(f"  {name:<{width}}"), _shown(column)]
    if bracketed:
        parts += [sql("  ("), _shown(bracketed), sql(")")]
    return Sql(f"concat({', '.join(parts)})")


def _text_block(column: str) -> Sql:
    return Sql(f"concat({sql(chr(10) + TEXT_BLOCKS[column] + chr(10) + '  ')}, {_given(column)})")


def _list_block(column: str) -> Sql:
    line = "concat('  ', CAST(i + 1 AS STRING), '. ', coalesce(t, 'None'))"
    listed = f"array_join(transform({column}, (t, i) -> {line}), {sql(chr(10))})"
    heading = sql(f"\n{LIST_BLOCKS[column]}\n")
    return Sql(f"IF(size({column}) > 0, concat({heading}, {listed}), NULL)")


def explanation_context(intelligence: DataFrame) -> DataFrame:
    """One document per account; blocks without content are left out."""
    lines = [sql(TITLE)]
    for heading, width, fields in FIELD_BLOCKS:
        lines.append(sql(f"\n{heading}"))
        lines += [_field_line(name, width, c, bracketed) for name, c, bracketed in fields]
    lines += [
        Sql(f"concat({sql(REVIEW_FLAG)}, IF(needs_human_review, 'Yes', 'No'))"),
        Sql(f"concat({sql(REVIEW_REASON)}, {_given('human_review_reason')})"),
        _text_block("recommended_next_action"),
        *[_list_block(column) for column in LIST_BLOCKS],
        _text_block("escalation_guidance"),
    ]
    document = Sql(f"concat_ws({sql(chr(10))}, {', '.join(lines)})")
    return intelligence.selectExpr("account_id", f"{document} AS context_text")


TEXT_FIELDS = (
    "ai_summary",
    "account_status_explanation",
    "recommended_next_step",
    "why_this_action_matters",
    "confidence_note",
)
# Fixed value: the note that goes with every explanation.
GUARDRAIL_NOTE = (
    "AI explains deterministic recommendations. It does not calculate scores or next steps."
)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _member(whole: Column, name: str) -> Column:
    return F.try_variant_get(whole, f"$.{name}", "variant")


def _is_text(value: Column) -> Column:
    return F.coalesce(_kind(value) == "STRING", F.lit(True))


def _text(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def _value_text(value: Column) -> Column:
    """Any value as text, with the spelling the stored answers' consumer uses for flags."""
    return (
        F.when(value.isNull(), "")
        .when(_kind(value) == "VOID", "None")
        .when(_kind(value) == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .otherwise(_text(value))
    )


def parse_explanations(responses: DataFrame, body: str = "response_json") -> DataFrame:
    """Read stored answers. ``parse_error`` is NULL for good rows and says why for the others.

    List entries that are not objects are dropped, absent texts become empty.
    """
    whole = F.col("__whole")
    entries = F.filter(F.col("__entries"), lambda entry: _kind(entry).startswith("OBJECT"))
    drivers = F.transform(
        entries,
        lambda entry: F.struct(
            _text(_member(entry, "signal")).alias("signal"),
            _value_text(_member(entry, "value")).alias("value"),
            _text(_member(entry, "interpretation")).alias("interpretation"),
        ),
    )
    texts_ok = F.lit(True)
    for name in TEXT_FIELDS:
        texts_ok = texts_ok & _is_text(_member(whole, name))
    drivers_ok = F.coalesce(
        F.forall(
            entries,
            lambda entry: _is_text(_member(entry, "signal"))
            & _is_text(_member(entry, "interpretation")),
        ),
        F.lit(True),
    )
    listed = _member(whole, "key_signal_drivers")
    return (
        responses.withColumn("__whole", whole_json(F.col(body)))
        .withColumn("__entries", F.try_variant_get(listed, "$", "array<variant>"))
        .withColumn(
            "parse_error",
            F.when(whole.isNull(), "not JSON")
            .when(~_kind(whole).startswith("OBJECT"), "not an object")
            .when(listed.isNotNull() & F.col("__entries").isNull(), "drivers are not a list")
            .when(~texts_ok | ~drivers_ok, "text expected"),
        )
        .withColumns(
            {
                name: F.when(F.col("parse_error").isNull(), _text(_member(whole, name)))
                for name in TEXT_FIELDS
            }
        )
        .withColumn(
            "key_signal_drivers",
            F.when(
                F.col("parse_error").isNull(),
                F.coalesce(
                    drivers,
                    F.array().cast("array<struct<signal:string,value:string,interpretation:string>>"),
                ),
            ),
        )
        .withColumn("guardrail_note", F.when(F.col("parse_error").isNull(), GUARDRAIL_NOTE))
        .drop("__whole", "__entries", body)
    )


def accepted_and_rejected(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("parse_error").isNull()
    return parsed.where(good).drop("parse_error"), parsed.where(~good)
