"""Checks of the base tables and of the derived relations.

Every check is a DataFrame of ``check, table_name, metric, value, status`` or of the offending
rows; nothing is collected. Keys are combined per task before they are counted.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.rules import by_value
from tallyscope.operators import scoring as S
from tallyscope.sources.readers import Tables, absent_columns, rejects_of
from tallyscope.sources.schemas import ACCOUNT_CHILDREN, CONTRACTS

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
REQUIRED_FIELDS = (
    "recommended_action_type",
    "recommended_action_priority",
    "suggested_owner_role",
    "recommended_due_date",
    "primary_business_motion",
)
PLAYBOOK_FIELDS = (
    "immediate_next_steps",
    "phase_2_next_steps",
    "success_metrics",
    "escalation_guidance",
)


def _stacked(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """All parts in one; without any, an empty frame of the schema."""
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


FINDING = "check string, table_name string, metric string, value bigint, status string"


def _pass_if_zero(value: Column) -> Column:
    return F.when(value == 0, PASS).otherwise(FAIL)


def _constant(spark: SparkSession, findings: list[tuple]) -> DataFrame:
    """Findings that need no data, as an inlined constant."""
    names = [column.split()[0] for column in FINDING.split(", ")]
    rows = [
        F.struct(
            *[
                (F.lit(v).cast("bigint") if n == "value" else F.lit(v)).alias(n)
                for n, v in zip(names, finding, strict=True)
            ]
        )
        for finding in findings
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def inputs_present(spark: SparkSession, tables: Tables) -> DataFrame:
    """One row per expected table; reads nothing from the tables."""
    return _constant(
        spark,
        [
            ("present", name, "found", int(name in tables), PASS if name in tables else FAIL)
            for name in CONTRACTS
        ],
    )


def missing_columns(spark: SparkSession, tables: Tables) -> DataFrame:
    """A failure for each required column, key or account id that a present table lacks."""
    findings = []
    for name, df in tables.items():
        contract = CONTRACTS[name]
        needed = dict.fromkeys(
            (contract.key, *contract.required, *(["account_id"] if name in ACCOUNT_CHILDREN else []))
        )
        absent = set(absent_columns(df, contract))
        findings += [("missing_column", name, c, 1, FAIL) for c in needed if c in absent]
    return _constant(spark, findings) if findings else spark.createDataFrame([], FINDING)


def row_counts(tables: Tables) -> DataFrame:
    """Also for derived relations: any mapping of name to DataFrame."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ],
    )


def derived_row_counts(intelligence: DataFrame) -> DataFrame:
    """Counts of the three relations that are projections of one another, from one of them.

    ``intelligence`` is best a written table (``Portfolio.written``); it is counted once.
    """
    names = ("recommended_actions_engine", "account_action_playbook", "account_intelligence_view")
    return intelligence.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.explode(F.array(*map(F.lit, names))).alias("table_name"), "row_count"
    )


TABLE_FACTS = "table_name string, row_count bigint, null_keys bigint, duplicate_keys bigint"


def table_facts(spark: SparkSession, tables: Tables) -> DataFrame:
    """Rows, missing keys, and rows beyond the first of each key, from one read of each table.

    A table without its key column has all keys missing. The rows of a key are combined per task, so
    the shuffle carries each key once a task, and only counts come together.
    """
    parts = []
    for name, df in tables.items():
        key = CONTRACTS[name].key
        named = F.col(key) if key in df.columns else F.lit(None).cast("string")
        by_key = df.groupBy(named.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        known = F.col("key").isNotNull()
        parts.append(
            by_key.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("null_keys"),
                F.coalesce(F.sum(F.when(known, F.col("rows") - 1)), F.lit(0)).alias("beyond"),
            ).select(
                F.lit(name).alias("table_name"),
                "row_count",
                "null_keys",
                # missing keys count as one key
                (F.col("beyond") + F.greatest(F.col("null_keys") - 1, F.lit(0))).alias("duplicate_keys"),
            )
        )
    return _stacked(parts, spark, TABLE_FACTS)


def _row_count_findings(facts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    wanted = F.expr(by_value("table_name", expected, None))
    return facts.where(wanted.isNotNull()).select(
        F.lit("row_count").alias("check"),
        "table_name",
        F.lit("rows").alias("metric"),
        F.col("row_count").alias("value"),
        F.when(F.col("row_count") == wanted, PASS).otherwise(WARN).alias("status"),
    )


def row_count_check(tables: Tables, expected: Mapping[str, int]) -> DataFrame:
    """A different count is a warning, never a failure."""
    return _row_count_findings(
        row_counts({name: df for name, df in tables.items() if name in expected}), expected
    )


def primary_keys(spark: SparkSession, tables: Tables) -> DataFrame:
    """Missing keys, and rows beyond the first of each key (missing keys count as one key)."""
    return table_facts(spark, tables).select(
        F.lit("primary_key").alias("check"),
        "table_name",
        "null_keys",
        "duplicate_keys",
        _pass_if_zero(F.col("null_keys") + F.col("duplicate_keys")).alias("status"),
    )


def foreign_key_orphans(spark: SparkSession, tables: Tables) -> DataFrame:
    """Distinct account ids of each child table that no account has, and rows without an id.

    Only distinct ids of a table meet the accounts. A child table without ``account_id`` fails, and
    without the accounts all ids are orphans. Rows without an id do not fail by themselves.
    """
    accounts = tables.get("accounts")
    if accounts is not None and "account_id" in accounts.columns:
        known = accounts.select(F.col("account_id").cast("string").alias("account_id"))
    else:
        known = spark.createDataFrame([], "account_id string")
    parts = []
    for name in ACCOUNT_CHILDREN:
        if name not in tables:
            continue
        absent = "account_id" in absent_columns(tables[name], CONTRACTS[name])
        id_of = F.lit(None).cast("string") if absent else F.col("account_id").cast("string")
        ids = tables[name].groupBy(id_of.alias("account_id")).agg(F.count(F.lit(1)).alias("rows"))
        unknown = ids.join(known, "account_id", "left_anti")
        parts.append(
            unknown.agg(
                F.count("account_id").alias("orphan_ids"),
                F.coalesce(F.sum(F.when(F.col("account_id").isNull(), F.col("rows"))), F.lit(0)).alias(
                    "null_ids"
                ),
            ).select(
                F.lit("foreign_key").alias("check"),
                F.lit(name).alias("table_name"),
                "orphan_ids",
                "null_ids",
                (F.lit(FAIL) if absent else _pass_if_zero(F.col("orphan_ids"))).alias("status"),
            )
        )
    return _stacked(
        parts,
        spark,
        "check string, table_name string, orphan_ids bigint, null_ids bigint, status string",
    )


NULLS = "table_name string, column_name string, null_count bigint"


def _null_counts(spark: SparkSession, tables: Tables, columns_of) -> DataFrame:
    parts = []
    for name, df in tables.items():
        columns = columns_of(CONTRACTS[name])
        if columns:
            counts = df.agg(
                *[
                    (
                        F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))
                    ).alias(c)
                    for c in columns
                ]
            )
            parts.append(
                counts.unpivot([], list(columns), "column_name", "null_count").select(
                    F.lit(name).alias("table_name"), "column_name", "null_count"
                )
            )
    return _stacked(parts, spark, NULLS)


def not_null(spark: SparkSession, tables: Tables) -> DataFrame:
    """NULLs per column that the contract requires; any of them is a failure."""
    return _null_counts(spark, tables, lambda contract: contract.required).select(
        F.lit("not_null").alias("check"),
        "table_name",
        "column_name",
        "null_count",
        _pass_if_zero(F.col("null_count")).alias("status"),
    )


def critical_nulls(spark: SparkSession, tables: Tables) -> DataFrame:
    """NULLs per critical column; for information, without effect on the verdict."""
    return _null_counts(spark, tables, lambda contract: contract.critical)


#: Kinds of entries of ``table_summary``.
_KEY, _ID, _NULL, _NO_ID, _REJECT = range(5)
SUMMARY = (
    "table_name string, row_count bigint, null_keys bigint, duplicate_keys bigint, "
    "null_counts map<string,bigint>, orphan_ids bigint, null_ids bigint, rejected_rows bigint"
)


def _entry(kind: int, value: Column | None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), (F.lit(None) if value is None else value).cast("string").alias("value")
    )


def _entries(name: str, df: DataFrame) -> DataFrame:
    """What a row adds to the checks: its key, its account id, and each required column that it lacks."""
    contract = CONTRACTS[name]
    absent = set(absent_columns(df, contract))

    def cell(column: str) -> Column:
        return F.lit(None).cast("string") if column in absent else F.col(column).cast("string")

    found = [_entry(_KEY, cell(contract.key))]
    if name in ACCOUNT_CHILDREN or name == "accounts":
        found.append(F.when(cell("account_id").isNotNull(), _entry(_ID, cell("account_id"))))
    if name in ACCOUNT_CHILDREN:
        found.append(F.when(cell("account_id").isNull(), _entry(_NO_ID, None)))
    found += [F.when(cell(c).isNull(), _entry(_NULL, F.lit(c))) for c in contract.required]
    return df.select(F.lit(name).alias("owner"), F.inline(F.array_compact(F.array(*found))))


def table_summary(spark: SparkSession, tables: Tables) -> DataFrame:
    """Rows, keys, NULLs, orphans and rejects of each table, from one read of each table.

    A row becomes an entry for its key, one for its account id, and one for each required column that
    is NULL (good data has none). Equal entries are combined per task before the only large shuffle.
    Account ids then meet across the tables, each with a bit for every table that holds it, so orphans
    need no join. These are aggregates and not metrics observed beside a scan, because a stage that runs
    again after a lost executor would count such metrics twice.
    """
    rejects = rejects_of(tables)
    parts = [_entries(name, df) for name, df in tables.items()]
    parts += [
        df.select(F.lit(name).alias("owner"), F.lit(_REJECT).alias("kind"), F.lit(None).cast("string").alias("value"))
        for name, df in rejects.items()
    ]
    if not parts:
        return spark.createDataFrame([], SUMMARY)
    bit = {name: 1 << i for i, name in enumerate(CONTRACTS)}
    kind, is_id = F.col("kind"), F.col("kind") == _ID
    combined = (
        _stacked(parts, spark, "")
        .groupBy("owner", "kind", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    met = combined.groupBy(
        "kind",
        F.when(~is_id, F.col("owner")).alias("owner"),
        F.when(kind.isin(_ID, _NULL), F.col("value")).alias("value"),
    ).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("rows"))).alias("without"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("rows") - 1)).alias("beyond"),
        F.bit_or(F.expr(by_value("owner", bit, 0))).alias("holders"),
    )

    def holds(name: str) -> Column:
        return F.col("holders").bitwiseAND(F.lit(bit[name])) != 0

    orphan = [F.when(holds(name) & ~holds("accounts"), F.lit(name)) for name in ACCOUNT_CHILDREN]
    of = F.when(is_id, F.array_compact(F.array(*orphan))).otherwise(F.array("owner"))
    counted = met.select(F.explode(of).alias("table_name"), "kind", "value", "rows", "without", "beyond")

    def total(which: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == which, F.col(column))), F.lit(0).cast("bigint"))

    null_keys = total(_KEY, "without")
    per_table = counted.groupBy("table_name").agg(
        total(_KEY, "rows").alias("row_count"),
        null_keys.alias("null_keys"),
        # missing keys count as one key
        (total(_KEY, "beyond") + F.greatest(null_keys - 1, F.lit(0))).alias("duplicate_keys"),
        F.map_from_entries(F.collect_list(F.when(kind == _NULL, F.struct("value", "rows")))).alias("null_counts"),
        F.count_if(is_id).alias("orphan_ids"),
        total(_NO_ID, "rows").alias("null_ids"),
        total(_REJECT, "rows").alias("rejected_rows"),
    )
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, tables))).alias("table_name"))
    numbers = [c for c in per_table.columns if c not in ("table_name", "null_counts")]
    return listed.join(per_table, "table_name", "left").select(
        *[
            F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) if c in numbers else F.col(c)
            for c in per_table.columns
        ]
    )


def quality_report(
    spark: SparkSession, tables: Tables, expected: Mapping[str, int] | None = None
) -> DataFrame:
    """All findings with a status; absent tables are reported and skipped by the other checks.

    Each table is read once (``table_summary``). Tables from CSV files also have the number of rows
    in the file, and a failure if some of them were rejected.
    """
    rejects = rejects_of(tables)
    keys = F.col("null_keys") + F.col("duplicate_keys")

    def finding(check: str | Column, metric: str | Column, value: Column, status: Column) -> Column:
        check, metric = (F.lit(x) if isinstance(x, str) else x for x in (check, metric))
        value = value.cast("bigint")
        return F.struct(check.alias("check"), metric.alias("metric"), value.alias("value"), status.alias("status"))

    def only(names, one: Column) -> Column:
        return F.when(F.col("table_name").isin(*names), one)

    wanted = F.expr(by_value("table_name", expected, None)) if expected else F.lit(None).cast("bigint")
    lacking = [
        name for name in ACCOUNT_CHILDREN if name in tables and "account_id" in absent_columns(tables[name], CONTRACTS[name])
    ]
    orphans = F.when(F.col("table_name").isin(*lacking), FAIL).otherwise(_pass_if_zero(F.col("orphan_ids")))
    in_file = F.col("row_count") + F.col("rejected_rows")
    count_status = F.when(F.col("row_count") == wanted, PASS).otherwise(WARN)
    findings = [
        finding("primary_key", "null_or_duplicate", keys, _pass_if_zero(keys)),
        F.when(wanted.isNotNull(), finding("row_count", "rows", F.col("row_count"), count_status)),
        only(rejects, finding("rows_in_file", "rows", in_file, F.lit(PASS))),
        only(rejects, finding("rejected_rows", "rows", F.col("rejected_rows"), _pass_if_zero(F.col("rejected_rows")))),
    ]
    if "accounts" in tables:
        findings.append(
            only(ACCOUNT_CHILDREN, finding("foreign_key", "orphan_ids", F.col("orphan_ids"), orphans))
        )
    for name in tables:
        for column in CONTRACTS[name].required:
            count = F.coalesce(F.col("null_counts")[column], F.lit(0).cast("bigint"))
            findings.append(only([name], finding("not_null", column, count, _pass_if_zero(count))))
    found = table_summary(spark, tables).select("table_name", F.inline(F.array_compact(F.array(*findings))))
    parts = [inputs_present(spark, tables), missing_columns(spark, tables)]
    parts.append(found.select("check", "table_name", "metric", "value", "status"))
    return _stacked(parts, spark, FINDING)


def quality_summary(report: DataFrame) -> DataFrame:
    """Totals by status and the verdict: any failure rejects the data."""
    totals = report.agg(
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.count_if(F.col("status") == WARN).alias("warned"),
        F.count_if(F.col("status") == FAIL).alias("failed"),
    )
    return totals.withColumn(
        "verdict", F.when(F.col("failed") > 0, "rejected").otherwise("accepted")
    )


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    return (
        accounts.groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
    )


def missing_accounts(accounts: DataFrame, intelligence: DataFrame) -> DataFrame:
    return accounts.select("account_id", "company_name").join(
        intelligence.select("account_id"), "account_id", "left_anti"
    )


def _any_null(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).isNull() for name in columns])


def playbook_gaps(intelligence: DataFrame) -> DataFrame:
    """Rows lacking a required field or a playbook text, with which of the two."""
    return (
        intelligence.select(
            "account_id",
            "company_name",
            _any_null(REQUIRED_FIELDS).alias("lacks_required_field"),
            _any_null(PLAYBOOK_FIELDS).alias("lacks_playbook_text"),
        )
        .where("lacks_required_field OR lacks_playbook_text")
    )


_SCORES = {"health": S.HEALTH, "churn": S.CHURN, "expansion": S.EXPANSION}


def score_range(intelligence: DataFrame) -> DataFrame:
    return intelligence.agg(
        *[
            extreme(score).alias(f"{prefix}_{name}")
            for name, score in _SCORES.items()
            for prefix, extreme in (("min", F.min), ("max", F.max))
        ],
        F.count_if(_out_of_range()).alias("rows_out_of_range"),
    )


def _out_of_range() -> Column:
    return reduce(lambda a, b: a | b, [~F.col(c).between(0, 100) for c in _SCORES.values()])


def scores_out_of_range(intelligence: DataFrame) -> DataFrame:
    return intelligence.where(_out_of_range()).select(
        "account_id", "company_name", *_SCORES.values()
    )


def kpi_subset(dashboard_kpis: DataFrame) -> DataFrame:
    return dashboard_kpis.select(
        "total_accounts",
        "critical_risk_accounts",
        "high_risk_accounts",
        "high_expansion_accounts",
        "accounts_needing_human_review",
        "total_arr",
        "arr_at_risk",
    )


def risk_subset(risk_summary: DataFrame) -> DataFrame:
    return risk_summary.select("risk_level", "account_count", "avg_churn_risk_score", "total_arr")


def owner_subset(owner_workload: DataFrame) -> DataFrame:
    return owner_workload.select(
        "suggested_owner_role",
        "assigned_account_count",
        "critical_action_count",
        "high_action_count",
        "human_review_count",
        "total_arr_owned",
    )
