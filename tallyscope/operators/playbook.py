"""The action playbook: which branch applies to an account, and its texts filled with numbers."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.binding import with_sql
from tallyscope.functions.rules import Sql, aliased, every, first_match, sql
from tallyscope.functions.text import as_text, filled
from tallyscope.operators import scoring as S
from tallyscope.plans.playbook_content import PLAYS, Play

VERSION = "action_playbook_v1"

# Column behind each name that templates may put in braces.
FIELDS = {
    "tickets": "support_tickets_last_30_days",
    "usage": "usage_events_last_30_days",
    "users": "active_users_last_30_days",
    "overdue": "overdue_action_count",
    "nps": "nps_score",
    "days": "days_until_renewal",
    "health": S.HEALTH,
    "churn": S.CHURN,
    "exp": S.EXPANSION,
    "owner": "account_owner",
    "role": "suggested_owner_role",
    "due": "recommended_due_date",
}

_TEMPLATE = "STRUCT<fixed: STRING, pieces: ARRAY<STRUCT<text: STRING, field: INT>>>"
_CONTENT = (
    f"ARRAY<STRUCT<immediate: ARRAY<{_TEMPLATE}>, phase_2: ARRAY<{_TEMPLATE}>,"
    f" metrics: ARRAY<{_TEMPLATE}>, escalation: {_TEMPLATE}>>"
)

CARRIED = (
    "recommended_action_type",
    "recommended_action_priority",
    "computed_churn_risk_score",
    "computed_health_score",
    "computed_expansion_score",
    "support_tickets_last_30_days",
    "usage_events_last_30_days",
    "active_users_last_30_days",
    "overdue_action_count",
    "nps_score",
    "days_until_renewal",
    "risk_level_v2",
    "expansion_level_v2",
    "customer_priority_tier_v3",
    "suggested_owner_role",
    "recommended_due_date",
    "account_owner",
)
TEXT_COLUMNS = (
    "immediate_next_steps",
    "phase_2_next_steps",
    "success_metrics",
    "escalation_guidance",
    "timeline_label",
    "playbook_version",
)


def signals() -> dict[str, Sql]:
    """The 13 yes/no signals; an unknown input leaves a signal NULL."""
    tickets, usage = "support_tickets_last_30_days", "usage_events_last_30_days"
    # Thresholds.
    texts = {
        "high_support": f"{tickets} >= 5",
        "moderate_support": f"{tickets} >= 3 AND {tickets} < 5",
        "low_usage": f"{usage} <= 15",
        "high_usage": f"{usage} >= 50",
        "very_low_users": "active_users_last_30_days <= 5",
        "low_nps": "nps_score <= 5",
        "high_nps": "nps_score >= 8",
        "renewal_imminent": f"{S.RENEWAL} <= 30",
        "renewal_near": f"{S.RENEWAL} <= 90",
        "very_high_churn": f"{S.CHURN} >= 60",
        "healthy": f"{S.HEALTH} >= 65",
        "strong_expansion": f"{S.EXPANSION} >= 65",
        "has_overdue": "overdue_action_count >= 2",
    }
    return {name: Sql(text) for name, text in texts.items()}


def playbook_signals(recommended: DataFrame) -> DataFrame:
    return with_sql(recommended, signals())


def _template(text: str) -> dict:
    """Text without fields as it is; other text in pieces, fields by 1-based place in ``FIELDS``."""
    places = {name: place for place, name in enumerate(FIELDS, 1)}
    parts = re.split(r"\{(\w+)\}", text)
    if len(parts) == 1:
        return {"fixed": text}
    return {
        "pieces": [
            {"field": places[part]} if place % 2 else {"text": part}
            for place, part in enumerate(parts)
            if part
        ]
    }


def _content(plays: Sequence[Play]) -> Sql:
    """All branches in order as one constant, so that using the texts needs no join."""
    branches = [
        {
            "immediate": [_template(step) for step in branch.steps],
            "phase_2": [_template(step) for step in play.phase_2],
            "metrics": [_template(metric) for metric in play.metrics],
            "escalation": _template(play.escalation),
        }
        for play in plays
        for branch in play.branches
    ]
    return Sql(f"from_json({sql(json.dumps(branches))}, '{_CONTENT}')")


def _applies(play: Play, names: Sequence[str]) -> Sql:
    known = signals()
    tests = [] if play.action_type is None else [f"recommended_action_type = {sql(play.action_type)}"]
    return every([*tests, *[known[name] for name in names]])


def branch_number(plays: Sequence[Play] = PLAYS) -> Sql:
    """1-based place of the branch among all branches of all plays."""
    tests = [_applies(play, branch.signals) for play in plays for branch in play.branches]
    return first_match([(test, place) for place, test in enumerate(tests, 1)], None)


def timeline(plays: Sequence[Play] = PLAYS) -> Sql:
    return first_match(
        [(_applies(play, names), label) for play in plays for names, label in play.timeline], None
    )


def with_playbook(recommended: DataFrame, plays: Sequence[Play] = PLAYS) -> DataFrame:
    """Add the playbook columns to each row; a projection only, no join and no shuffle."""
    values = ", ".join(_shown(name, column) for name, column in FIELDS.items())
    kept = recommended.columns
    chosen = recommended.selectExpr(
        "*",
        f"element_at({_content(plays)}, {branch_number(plays)}) AS __branch",
        f"array({values}) AS __values",
    )

    def texts(name: str) -> Sql:
        one = filled("template", "__values")
        return Sql(f"transform(__branch.{name}, template -> {one})")

    return chosen.selectExpr(
        *kept,
        *aliased(
            {
                "immediate_next_steps": texts("immediate"),
                "phase_2_next_steps": texts("phase_2"),
                "success_metrics": texts("metrics"),
                "escalation_guidance": filled("__branch.escalation", "__values"),
                "timeline_label": timeline(plays),
                "playbook_version": VERSION,
            }
        ),
    )


def _shown(name: str, column: str) -> Sql:
    return Sql(f"coalesce({as_text(column)}, 'TBD')") if name == "due" else as_text(column)


def action_playbook(recommended: DataFrame, plays: Sequence[Play] = PLAYS) -> DataFrame:
    return with_playbook(recommended, plays).select(
        "account_id", F.col("company_name").alias("account_name"), *CARRIED, *TEXT_COLUMNS
    )


def playbook_steps(playbook: DataFrame) -> DataFrame:
    """One row per list entry: account, list, position from 1, text."""

    lists = ", ".join(
        f"transform({name}, (t, i) ->"
        f" struct('{name}' AS list_name, i + 1 AS step_number, t AS step_text))"
        for name in ("immediate_next_steps", "phase_2_next_steps", "success_metrics")
    )
    return playbook.selectExpr("account_id", f"inline(concat({lists}))")
