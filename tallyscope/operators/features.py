"""Per-account features from the six customer tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.numbers import average_of, day, days_from
from tallyscope.functions.rules import Bands, by_bands
from tallyscope.operators.joins import ROWS_PER_SLICE, fan_out_left_join
from tallyscope.sources.readers import Tables

ACTIVE_STATUSES = ("Pending", "In Progress")
URGENT_PRIORITIES = ("Critical", "High")
CLOSED_STAGES = ("Closed Won", "Closed Lost")

ENGAGEMENT_LABELS = {
    "meeting_engagement_level": Bands(
        "meetings_last_30_days", ((">=", 2, "high"), ("=", 1, "medium")), "low"
    ),
    "support_pressure_level": Bands(
        "support_tickets_last_30_days", ((">=", 8, "high"), (">=", 4, "medium")), "low"
    ),
    "nps_category": Bands(
        "nps_score", ((">=", 8, "promoter"), (">=", 5, "neutral")), "detractor"
    ),
}


def action_features(actions: DataFrame, as_of: date) -> DataFrame:
    active = F.col("status").isin(*ACTIVE_STATUSES)

    def with_status(value: str) -> Column:
        return F.count_if(F.col("status") == value)

    return actions.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_action_count"),
        F.count_if(active).alias("active_action_count"),
        with_status("Pending").alias("pending_action_count"),
        with_status("In Progress").alias("in_progress_action_count"),
        with_status("Completed").alias("completed_action_count"),
        with_status("Dismissed").alias("dismissed_action_count"),
        F.count_if(F.col("priority").isin(*URGENT_PRIORITIES)).alias("high_priority_action_count"),
        F.count_if(F.col("priority") == "Critical").alias("critical_action_count"),
        F.count_if(active & (F.col("due_date") < day(as_of))).alias("overdue_action_count"),
        F.min(F.when(active, F.col("due_date"))).alias("next_open_action_due_date"),
    )


def engagement_features(engagement: DataFrame, as_of: date) -> DataFrame:
    """One output row per input row: a repeated account is passed on, not merged."""
    opened, replied = F.col("emails_opened"), F.col("emails_replied")
    reply_share = replied.cast("decimal(10,0)") / opened.cast("decimal(10,0)")
    return engagement.select(
        "engagement_id",
        "account_id",
        "emails_opened",
        "emails_replied",
        "meetings_last_30_days",
        "support_tickets_last_30_days",
        "nps_score",
        "last_touch_date",
        days_from(F.col("last_touch_date"), day(as_of)).alias("days_since_last_touch"),
        F.when(opened > 0, F.round(reply_share * 100, 2).cast("decimal(14,2)"))
        .otherwise(F.lit(0).cast("decimal(14,2)"))
        .alias("email_reply_rate_percent"),
        *[F.expr(by_bands(bands)).alias(name) for name, bands in ENGAGEMENT_LABELS.items()],
    )


def opportunity_features(opportunities: DataFrame, as_of: date) -> DataFrame:
    is_open = ~F.col("pipeline_stage").isin(*CLOSED_STAGES)
    grows = F.col("opportunity_type").ilike("%expansion%") | F.col("opportunity_type").ilike(
        "%upsell%"
    )
    weighted = F.col("amount") * F.col("probability") * F.lit("0.01").cast("decimal(2,2)")
    return opportunities.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_opportunity_count"),
        F.count_if(is_open).alias("open_opportunity_count"),
        F.coalesce(F.sum(F.when(is_open, F.col("amount"))), F.lit(0))
        .cast("decimal(22,2)")
        .alias("open_pipeline_value"),
        F.coalesce(F.sum(F.when(is_open, weighted)), F.lit(0))
        .cast("decimal(36,4)")
        .alias("weighted_pipeline_value"),
        F.min(F.when(is_open, F.col("expected_close_date"))).alias("next_expected_close_date"),
        days_from(F.max("last_activity_date"), day(as_of)).alias("days_since_last_crm_activity"),
        F.count_if(grows).alias("expansion_opportunity_count"),
    )


def latest_scores(score_history: DataFrame) -> DataFrame:
    """Newest row per account; a missing date counts as newest, equal dates go by ``score_id``.

    As an aggregate, not a window: each task forwards one row per account, and Catalyst knows the
    result to be unique by account, so reports without these columns skip the whole branch. Spark
    sorts for it, since the row it holds is a struct; finding the newest date first and joining back
    """
    age = F.struct(
        F.col("calculated_at").isNotNull(),
        -F.unix_date("calculated_at"),
        F.col("score_id"),
    )
    row = F.struct(*[name for name in score_history.columns if name != "account_id"])
    newest = score_history.groupBy("account_id").agg(F.min_by(row, age).alias("__newest"))
    return newest.select(
        F.col("__newest.score_id").alias("score_id"),
        "account_id",
        F.col("__newest.health_score").alias("latest_health_score"),
        F.col("__newest.churn_score").alias("latest_churn_score"),
        F.col("__newest.expansion_score").alias("latest_expansion_score"),
        F.col("__newest.score_reason").alias("latest_score_reason"),
        F.col("__newest.calculated_at").alias("latest_score_date"),
    )


def usage_features(events: DataFrame, as_of: date) -> DataFrame:
    """Event counts, distinct users and features per account, in two steps.

    Three distinct counts in one ``groupBy`` would copy each event four times. Grouping first by
    (account, user) and (account, feature) needs two copies, combines them before the shuffle and
    spreads a hot account over its users; the second step only adds up those groups. Minutes are
    summed as whole cents: a decimal this wide would leave the fast path of the aggregation.
    """
    stamp = F.col("event_timestamp")

    def since(days: int) -> Column:
        return stamp >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz")

    narrow = events.select(
        "account_id",
        "user_id",
        "feature_name",
        stamp,
        since(30).alias("__in_30"),
        since(7).alias("__in_7"),
        (F.col("session_duration_minutes") * 100).cast("bigint").alias("__cents"),
    )
    groups = narrow.groupingSets(
        [[F.col("account_id"), F.col("user_id")], [F.col("account_id"), F.col("feature_name")]],
        "account_id",
        "user_id",
        "feature_name",
    ).agg(
        F.grouping("feature_name").alias("__by_user"),
        F.count(F.lit(1)).alias("__events"),
        F.count_if("__in_30").alias("__events_30"),
        F.count_if("__in_7").alias("__events_7"),
        F.sum("__cents").alias("__cents"),
        F.count("__cents").alias("__sessions"),
        F.max("event_timestamp").alias("__last"),
    )
    by_user = F.col("__by_user") == 1

    def total(name: str) -> Column:
        return F.sum(F.when(by_user, F.col(name)))

    user_known = by_user & F.col("user_id").isNotNull()
    last_event = F.max(F.when(by_user, F.col("__last")))
    minutes = total("__cents").cast("decimal(22,0)") * F.lit("0.01").cast("decimal(2,2)")
    return groups.groupBy("account_id").agg(
        total("__events").alias("total_usage_events"),
        total("__events_30").alias("usage_events_last_30_days"),
        total("__events_7").alias("usage_events_last_7_days"),
        F.count_if(user_known).alias("active_users_total"),
        F.count_if(user_known & (F.col("__events_30") > 0)).alias("active_users_last_30_days"),
        F.count_if(~by_user & F.col("feature_name").isNotNull()).alias("distinct_features_used"),
        average_of(minutes, total("__sessions"))
        .cast("decimal(10,2)")
        .alias("avg_session_duration_minutes"),
        last_event.alias("last_product_event_at"),
        days_from(last_event.cast("date"), day(as_of)).alias("days_since_last_product_event"),
    )


ACCOUNT_COLUMNS = (
    "company_name",
    "industry",
    "segment",
    "company_size",
    "annual_recurring_revenue",
    "plan_type",
    "customer_stage",
    "account_owner",
    "contract_start_date",
    "renewal_date",
    "created_at",
    "updated_at",
)
USAGE_COLUMNS = (
    "total_usage_events",
    "usage_events_last_30_days",
    "usage_events_last_7_days",
    "active_users_total",
    "active_users_last_30_days",
    "distinct_features_used",
    "avg_session_duration_minutes",
    "last_product_event_at",
    "days_since_last_product_event",
)
ENGAGEMENT_COLUMNS = (
    "emails_opened",
    "emails_replied",
    "meetings_last_30_days",
    "support_tickets_last_30_days",
    "nps_score",
    "last_touch_date",
    "days_since_last_touch",
    "email_reply_rate_percent",
    "meeting_engagement_level",
    "support_pressure_level",
    "nps_category",
)
OPPORTUNITY_COLUMNS = (
    "total_opportunity_count",
    "open_opportunity_count",
    "open_pipeline_value",
    "weighted_pipeline_value",
    "next_expected_close_date",
    "days_until_next_expected_close",
    "days_since_last_crm_activity",
    "expansion_opportunity_count",
)
SCORE_COLUMNS = (
    "latest_health_score",
    "latest_churn_score",
    "latest_expansion_score",
    "latest_score_reason",
    "latest_score_date",
)
ACTION_COLUMNS = (
    "total_action_count",
    "active_action_count",
    "pending_action_count",
    "in_progress_action_count",
    "completed_action_count",
    "dismissed_action_count",
    "high_priority_action_count",
    "critical_action_count",
    "overdue_action_count",
    "next_open_action_due_date",
)
FEATURE_COLUMNS = (
    "account_id",
    *ACCOUNT_COLUMNS,
    "days_until_renewal",
    *USAGE_COLUMNS,
    *ENGAGEMENT_COLUMNS,
    *OPPORTUNITY_COLUMNS,
    *SCORE_COLUMNS,
    *ACTION_COLUMNS,
)

# Joined numbers that become 0 without a matching row; all other columns stay unknown.
ZERO_FILLED = {
    *USAGE_COLUMNS[:7],
    *ENGAGEMENT_COLUMNS[:4],
    "email_reply_rate_percent",
    *OPPORTUNITY_COLUMNS[:4],
    "expansion_opportunity_count",
    *ACTION_COLUMNS[:9],
}


def account_features(tables: Tables, as_of: date, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One wide row per account (and per engagement row, should an account have several).

    Four sides are keyed by account and unique, so they line up on one hash partitioning. The
    engagement table promises no uniqueness and goes last, through the join that spreads repeats:
    an account with more than ``rows_per_slice`` engagement rows is dealt over several join keys.
    """
    engagement = engagement_features(tables["customer_engagement"], as_of)
    unique_per_account = (
        tables["accounts"]
        .join(usage_features(tables["product_usage_events"], as_of), "account_id", "left")
        .join(opportunity_features(tables["crm_opportunities"], as_of), "account_id", "left")
        .join(latest_scores(tables["score_history"]).drop("score_id"), "account_id", "left")
        .join(action_features(tables["actions"], as_of), "account_id", "left")
    )
    joined = fan_out_left_join(
        unique_per_account, engagement, "account_id", "engagement_id", rows_per_slice
    )
    derived = {
        "days_until_renewal": f"datediff(renewal_date, DATE'{as_of}')",
        "days_until_next_expected_close": f"datediff(next_expected_close_date, DATE'{as_of}')",
        "avg_session_duration_minutes": (
            "CAST(coalesce(avg_session_duration_minutes, 0) AS DECIMAL(10,2))"
        ),
    }
    return joined.selectExpr(
        *[
            f"{derived[name]} AS {name}"
            if name in derived
            else f"coalesce({name}, 0) AS {name}"
            if name in ZERO_FILLED
            else name
            for name in FEATURE_COLUMNS
        ]
    )
