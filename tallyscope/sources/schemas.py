"""Contracts of the eight base tables: columns, types, keys and the checks that hang off them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TEXT = T.StringType()
_INT = T.IntegerType()
_DATE = T.DateType()
_STAMP = T.TimestampNTZType()
_MONEY = T.DecimalType(12, 2)
_MINUTES = T.DecimalType(10, 2)
_SCORE = T.DecimalType(5, 2)


@dataclass(frozen=True)
class TableContract:
    """``required`` columns are NOT NULL; ``critical`` ones are counted in the null report."""

    name: str
    key: str
    columns: tuple[tuple[str, T.DataType], ...]
    required: tuple[str, ...]
    has_account: bool = False
    critical: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(name, kind, name not in self.required) for name, kind in self.columns]
        )


CONTRACTS: dict[str, TableContract] = {
    c.name: c
    for c in (
        TableContract(
            name="accounts",
            key="account_id",
            columns=(
                ("account_id", _TEXT),
                ("company_name", _TEXT),
                ("industry", _TEXT),
                ("segment", _TEXT),
                ("company_size", _INT),
                ("annual_recurring_revenue", _MONEY),
                ("plan_type", _TEXT),
                ("customer_stage", _TEXT),
                ("account_owner", _TEXT),
                ("contract_start_date", _DATE),
                ("renewal_date", _DATE),
                ("created_at", _STAMP),
                ("updated_at", _STAMP),
            ),
            required=("account_id", "company_name"),
            critical=("account_id", "company_name", "annual_recurring_revenue", "renewal_date"),
        ),
        TableContract(
            name="product_usage_events",
            key="event_id",
            columns=(
                ("event_id", _TEXT),
                ("account_id", _TEXT),
                ("user_id", _TEXT),
                ("event_type", _TEXT),
                ("feature_name", _TEXT),
                ("session_duration_minutes", _MINUTES),
                ("event_timestamp", _STAMP),
            ),
            required=("event_id", "account_id"),
            has_account=True,
        ),
        TableContract(
            name="customer_engagement",
            key="engagement_id",
            columns=(
                ("engagement_id", _TEXT),
                ("account_id", _TEXT),
                ("emails_opened", _INT),
                ("emails_replied", _INT),
                ("meetings_last_30_days", _INT),
                ("support_tickets_last_30_days", _INT),
                ("nps_score", _INT),
                ("last_touch_date", _DATE),
            ),
            required=("engagement_id", "account_id"),
            has_account=True,
            critical=("account_id", "nps_score", "support_tickets_last_30_days"),
        ),
        TableContract(
            name="crm_opportunities",
            key="opportunity_id",
            columns=(
                ("opportunity_id", _TEXT),
                ("account_id", _TEXT),
                ("opportunity_type", _TEXT),
                ("pipeline_stage", _TEXT),
                ("amount", _MONEY),
                ("probability", _INT),
                ("created_date", _DATE),
                ("expected_close_date", _DATE),
                ("last_activity_date", _DATE),
            ),
            required=("opportunity_id", "account_id"),
            has_account=True,
        ),
        TableContract(
            name="score_history",
            key="score_id",
            columns=(
                ("score_id", _TEXT),
                ("account_id", _TEXT),
                ("health_score", _SCORE),
                ("churn_score", _SCORE),
                ("expansion_score", _SCORE),
                ("score_reason", _TEXT),
                ("calculated_at", _DATE),
            ),
            required=("score_id", "account_id"),
            has_account=True,
            critical=(
                "account_id",
                "health_score",
                "churn_score",
                "expansion_score",
                "calculated_at",
            ),
        ),
        TableContract(
            name="actions",
            key="action_id",
            columns=(
                ("action_id", _TEXT),
                ("account_id", _TEXT),
                ("recommended_action", _TEXT),
                ("assigned_to", _TEXT),
                ("priority", _TEXT),
                ("status", _TEXT),
                ("due_date", _DATE),
                ("completed_at", _STAMP),
                ("outcome", _TEXT),
                ("created_at", _STAMP),
            ),
            required=("action_id", "account_id"),
            has_account=True,
            critical=("account_id", "priority", "status"),
        ),
        TableContract(
            name="experiments",
            key="experiment_id",
            columns=(
                ("experiment_id", _TEXT),
                ("experiment_name", _TEXT),
                ("hypothesis", _TEXT),
                ("target_accounts", _INT),
                ("success_metric", _TEXT),
                ("result", _TEXT),
                ("decision", _TEXT),
                ("created_at", _STAMP),
            ),
            required=("experiment_id",),
        ),
        TableContract(
            name="system_logs",
            key="log_id",
            columns=(
                ("log_id", _TEXT),
                ("log_type", _TEXT),
                ("component", _TEXT),
                ("status", _TEXT),
                ("message", _TEXT),
                ("created_at", _STAMP),
            ),
            required=("log_id",),
        ),
    )
}

ACCOUNT_CHILDREN = tuple(c.name for c in CONTRACTS.values() if c.has_account)
