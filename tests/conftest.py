from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tallyscope.operators.scoring import SCORING_INPUTS  # noqa: E402
from tallyscope.sources.schemas import CONTRACTS  # noqa: E402

AS_OF = date(2024, 2, 5)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.debug.maxToStringFields", "5000")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def table(spark, name: str, *rows: dict):
    """A base table from partial rows; columns left out are NULL."""
    contract = CONTRACTS[name]
    columns = [column for column, _ in contract.columns]
    unknown = {key for row in rows for key in row} - set(columns)
    assert not unknown, unknown
    schema = contract.schema
    for field in schema.fields:
        field.nullable = True
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


SIGNALS = dict(
    company_name="Acme",
    industry="FinTech",
    segment="Startup",
    company_size=10,
    annual_recurring_revenue=Decimal("1000.00"),
    plan_type="Starter",
    customer_stage="Active",
    account_owner="Ann",
    renewal_date=None,
    days_until_renewal=200,
    usage_events_last_30_days=0,
    active_users_last_30_days=0,
    support_tickets_last_30_days=0,
    nps_score=None,
    days_since_last_touch=None,
    overdue_action_count=0,
    open_pipeline_value=Decimal("0.00"),
    expansion_opportunity_count=0,
    latest_health_score=None,
    latest_churn_score=None,
    latest_expansion_score=None,
    latest_score_reason=None,
    latest_score_date=None,
)
SIGNAL_TYPES = dict(
    company_size="int",
    annual_recurring_revenue="decimal(12,2)",
    renewal_date="date",
    days_until_renewal="int",
    usage_events_last_30_days="bigint",
    active_users_last_30_days="bigint",
    support_tickets_last_30_days="int",
    nps_score="int",
    days_since_last_touch="int",
    overdue_action_count="bigint",
    open_pipeline_value="decimal(22,2)",
    expansion_opportunity_count="bigint",
    latest_health_score="decimal(5,2)",
    latest_churn_score="decimal(5,2)",
    latest_expansion_score="decimal(5,2)",
    latest_score_date="date",
)


def frame(spark, types: dict[str, str], defaults: dict, cases: list[dict]):
    """One row per case over the defaults; ``account_id`` is the case number."""
    names = ["account_id", *types]
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    rows = [
        (str(place), *[{**defaults, **case}[n] for n in types]) for place, case in enumerate(cases)
    ]
    return spark.createDataFrame(rows, schema)


def feature_rows(spark, cases: list[dict]):
    types = {n: SIGNAL_TYPES.get(n, "string") for n in SCORING_INPUTS if n != "account_id"}
    return frame(spark, types, SIGNALS, cases)


def values(df, *columns: str) -> list:
    """Column values in account order; a single column without tuples."""
    ordered = sorted(df.select("account_id", *columns).collect(), key=lambda r: int(r[0]))
    return [tuple(row[1:]) if len(columns) > 1 else row[1] for row in ordered]
