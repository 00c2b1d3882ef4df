"""The eight base tables derived from the star-schema test tables, every source row kept.

Each formula uses integer or IEEE double arithmetic, so ``oracle.BASE_TABLES`` can state the same
tables in another engine. Ids that point nowhere stand in for missing rows: they leave some
accounts without engagement and give the foreign-key check something to find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2024, 2, 5)

_TODAY = f"date'{AS_OF}'"
INDUSTRIES = ("FinTech", "MarTech", "EdTech", "HealthTech", "LegalTech", "SalesTech", "HRTech")
FEATURE_NAMES = (
    "Dashboard", "Reports", "Settings", "Integrations", "Analytics", "API", "Admin",
)


def _pick(index: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


def _day(offset: str) -> str:
    return f"date_add({_TODAY}, cast({offset} as int))"


def _stamp(days: str, seconds: str) -> str:
    return f"timestampadd(SECOND, cast({seconds} as int), cast({_day(days)} as timestamp_ntz))"


# Declared so that opening a table reads no file footers.
SOURCE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
        " o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
        " l_returnflag STRING"
    ),
    "part": "p_partkey BIGINT, p_name STRING, p_type STRING, p_size INT",
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE,"
        " props STRING"
    ),
}

Source = Callable[[str], DataFrame]


def _accounts(source: Source) -> DataFrame:
    return source("customer").selectExpr(
        "cast(c_custkey as string) as account_id",
        "c_name as company_name",
        f"{_pick('c_custkey % 7', INDUSTRIES)} as industry",
        f"{_pick('c_nationkey % 3', ('Startup', 'Mid-Market', 'Enterprise'))} as segment",
        "cast(10 + (c_custkey * 97) % 4990 as int) as company_size",
        "cast(abs(cast(c_acctbal as decimal(12,2))) * 20 as decimal(12,2))"
        " as annual_recurring_revenue",
        f"{_pick('c_custkey % 3', ('Starter', 'Professional', 'Enterprise'))} as plan_type",
        f"{_pick('c_custkey % 5', ('Active', 'Healthy', 'At Risk', 'Onboarding', 'Churned'))}"
        " as customer_stage",
        "if(c_custkey % 31 = 30, null, concat('Owner ', c_custkey % 5)) as account_owner",
        f"{_day('-((c_custkey * 29) % 700)')} as contract_start_date",
        f"if(c_custkey % 23 = 22, null, {_day('(c_custkey * 37) % 400 - 10')}) as renewal_date",
        f"{_stamp('-((c_custkey * 29) % 700)', '0')} as created_at",
        f"{_stamp('0', '0')} as updated_at",
    )


def _with_account(source: Source, table: str, seed: str) -> DataFrame:
    """``u`` in [0, 1) cubed, times the account count: a few accounts get most of the rows."""
    accounts = source("customer").selectExpr("cast(count(*) as double) as n").scalar()
    return (
        source(table)
        .withColumns({"x": F.expr(seed), "n": accounts})
        .selectExpr("*", "cast(x % 1000003 as double) / cast(1000003 as double) as u")
        .selectExpr("*", "cast(floor(n * u * u * u) as bigint) as acc")
    )


def _product_usage_events(source: Source) -> DataFrame:
    session_events = _with_account(source, "events", "event_id * 7919").selectExpr(
        "cast(event_id as string) as event_id",
        "cast(acc as string) as account_id",
        "if(event_id % 97 = 96, null, concat('u', user_id % (3 + (acc * 13) % 70))) as user_id",
        "event_type",
        f"{_pick('event_id % 7', FEATURE_NAMES)} as feature_name",
        "cast(value as decimal(10,2)) as session_duration_minutes",
        "ts as event_timestamp",
    )
    workflow_events = _with_account(
        source, "lineitem", "l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709"
    ).selectExpr(
        "concat_ws('-', 'w', l_orderkey, l_linenumber) as event_id",
        "cast(acc as string) as account_id",
        "concat('u', (x div 7) % (3 + (acc * 13) % 70)) as user_id",
        "l_returnflag as event_type",
        f"{_pick('l_partkey % 7', FEATURE_NAMES)} as feature_name",
        "if(x % 89 = 88, null, cast(l_quantity as decimal(10,2))) as session_duration_minutes",
        f"{_stamp('2 - x % 120', 'x % 86400')} as event_timestamp",
    )
    return session_events.unionByName(workflow_events)


def _customer_engagement(source: Source) -> DataFrame:
    return source("customer").selectExpr("c_custkey as k", "c_custkey % 9973 as m").selectExpr(
        "concat('e', k) as engagement_id",
        "concat(if(k % 19 = 18, 'x', ''), k) as account_id",
        "cast((k * 3) % 31 as int) as emails_opened",
        "cast((k * 5) % 11 as int) as emails_replied",
        "cast((k * 7) % 4 as int) as meetings_last_30_days",
        "cast((m * m + 3 * m) % 12 as int) as support_tickets_last_30_days",
        "if(k % 17 = 16, null, cast((m * m * 5 + m) % 11 as int)) as nps_score",
        f"{_day('-((k * 11) % 80)')} as last_touch_date",
    )


def _crm_opportunities(source: Source) -> DataFrame:
    return source("orders").selectExpr("*", "o_orderkey as k").selectExpr(
        "concat('o', k) as opportunity_id",
        "cast(o_custkey as string) as account_id",
        "case k % 16 when 0 then 'Expansion' when 1 then 'Team upsell'"
        " when 2 then 'Cross-sell' else 'Renewal' end as opportunity_type",
        "case when k % 211 = 210 then null"
        " when k % 4 <> 0 or o_custkey % 5 = 0 then if(k % 2 = 0, 'Closed Won', 'Closed Lost')"
        " when o_orderstatus = 'O' then 'Proposal' when o_orderstatus = 'P' then 'Negotiation'"
        " else 'Prospecting' end as pipeline_stage",
        "cast(cast(o_totalprice as decimal(12,2)) * cast('0.25' as decimal(3,2)) as decimal(12,2))"
        " as amount",
        "cast(10 + k * 7 % 81 as int) as probability",
        f"{_day('-(30 + k * 13 % 150)')} as created_date",
        f"{_day('k * 17 % 300 - 30')} as expected_close_date",
        f"{_day('-(1 + k * 11 % 60)')} as last_activity_date",
    )


def _score_history(source: Source) -> DataFrame:
    return source("orders").selectExpr("*", "o_orderkey as k").selectExpr(
        "concat('s', k) as score_id",
        "cast(o_custkey as string) as account_id",
        *[
            f"cast(cast((k * {factor}) % 9001 as decimal(12,2)) * cast('0.01' as decimal(3,2))"
            f" as decimal(5,2)) as {name}_score"
            for name, factor in (("health", 31), ("churn", 37), ("expansion", 41))
        ],
        "concat('reason ', k % 4) as score_reason",
        f"if(k % 301 = 300, null, {_day('-(30 * (1 + k % 12))')}) as calculated_at",
    )


def _actions(source: Source) -> DataFrame:
    return source("orders").selectExpr("*", "o_orderkey as k").selectExpr(
        "concat('a', k) as action_id",
        "concat(if(k % 503 = 502, 'x', ''), o_custkey) as account_id",
        "concat('play ', k % 9) as recommended_action",
        "concat('Owner ', k % 5) as assigned_to",
        "case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High'"
        " when '3-MEDIUM' then 'Medium' else 'Low' end as priority",
        "case when k % 8 = 0 then 'Pending' when k % 8 = 1 then 'In Progress'"
        " when k % 8 in (2, 3) then 'Dismissed' else 'Completed' end as status",
        f"{_day('k % 61 - 40')} as due_date",
        "cast(null as timestamp_ntz) as completed_at",
        "cast(null as string) as outcome",
        f"{_stamp('-(k % 90)', '0')} as created_at",
    )


def _experiments(source: Source) -> DataFrame:
    return source("part").selectExpr(
        "concat('x', p_partkey) as experiment_id",
        "p_name as experiment_name",
        "cast(null as string) as hypothesis",
        "cast(10 + p_size % 41 as int) as target_accounts",
        "p_type as success_metric",
        "cast(null as string) as result",
        f"{_pick('p_partkey % 3', ('Scale', 'Stop', 'Continue'))} as decision",
        f"{_stamp('-(p_partkey % 365)', '0')} as created_at",
    )


def _system_logs(source: Source) -> DataFrame:
    return source("events").selectExpr(
        "cast(event_id as string) as log_id",
        "event_type as log_type",
        "concat('component ', user_id % 6) as component",
        "case when event_type = 'error' then 'Failed' when event_id % 9 = 0 then 'Warning'"
        " else 'Success' end as status",
        "props as message",
        "ts as created_at",
    )


_BUILDERS = {
    "accounts": _accounts,
    "product_usage_events": _product_usage_events,
    "customer_engagement": _customer_engagement,
    "crm_opportunities": _crm_opportunities,
    "score_history": _score_history,
    "actions": _actions,
    "experiments": _experiments,
    "system_logs": _system_logs,
}


class BaseTables(Mapping):
    """The tables by name, each put together when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._built: dict[str, DataFrame] = {}
        self._source = lambda name: spark.read.schema(SOURCE_SCHEMAS[name]).parquet(
            f"{sf_dir}/{name}.parquet"
        )

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = _BUILDERS[name](self._source)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(_BUILDERS)

    def __len__(self) -> int:
        return len(_BUILDERS)

    def __contains__(self, name: object) -> bool:
        return name in _BUILDERS


def base_tables(spark: SparkSession, sf_dir: str) -> BaseTables:
    return BaseTables(spark, sf_dir)
