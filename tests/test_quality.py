from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import AS_OF, table
from test_actions_and_labels import recommended

from tallyscope import Portfolio
from tallyscope.operators import quality
from tallyscope.operators.intelligence import account_intelligence, account_labels
from tallyscope.sources.readers import (
    CORRUPT,
    absent_columns,
    read_available_tables,
    read_csv_table,
    read_tables,
    split_csv_table,
    stage_csv_table,
    write_between_stages,
)
from tallyscope.sources.schemas import CONTRACTS


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "accounts": table(
            spark,
            "accounts",
            dict(account_id="a", company_name="A", annual_recurring_revenue=Decimal("1")),
            dict(account_id="b", company_name=None),
            dict(account_id="b", company_name="B"),
        ),
        "actions": table(
            spark,
            "actions",
            dict(action_id="1", account_id="a", priority="Low"),
            dict(action_id=None, account_id="gone"),
            dict(action_id=None, account_id="gone"),
            dict(action_id="2", account_id=None),
            dict(action_id="2", account_id="lost"),
        ),
        "system_logs": table(spark, "system_logs", dict(log_id="l")),
    }


def test_primary_keys_count_nulls_and_rows_beyond_the_first(spark, tables):
    found = {r.table_name: r for r in quality.primary_keys(spark, tables).collect()}
    assert (found["accounts"].null_keys, found["accounts"].duplicate_keys) == (0, 1)
    # Two missing keys are one duplicate, the repeated "2" another.
    assert (found["actions"].null_keys, found["actions"].duplicate_keys) == (2, 2)
    assert found["actions"].status == "FAIL" and found["system_logs"].status == "PASS"


def test_orphans_are_distinct_and_null_ids_apart(spark, tables):
    assert [tuple(r) for r in quality.foreign_key_orphans(spark, tables).collect()] == [
        ("foreign_key", "actions", 2, 1, "FAIL")
    ]


def test_critical_nulls(spark, tables):
    found = {
        (r.table_name, r.column_name): r.null_count
        for r in quality.critical_nulls(spark, tables).collect()
    }
    assert found["accounts", "company_name"] == 1 and found["accounts", "renewal_date"] == 3
    assert found["actions", "priority"] == 4 and found["actions", "account_id"] == 1
    assert len(found) == 7


def test_report_and_summary(spark, tables):
    report = quality.quality_report(spark, tables, {"accounts": 3, "actions": 4, "experiments": 1})
    statuses = {(r.check, r.table_name): r.status for r in report.collect()}
    assert statuses["present", "experiments"] == "FAIL"
    assert statuses["row_count", "accounts"] == "PASS"
    assert statuses["row_count", "actions"] == "WARN"
    assert ("row_count", "experiments") not in statuses
    summary = quality.quality_summary(report).first()
    # present 3/8, counts 1 of 2, keys 1 of 3, orphans 0 of 1, not null 2 of 5
    assert tuple(summary) == (7, 1, 11, "rejected")


def test_clean_tables_are_accepted(spark):
    clean = {name: table(spark, name) for name in CONTRACTS}
    summary = quality.quality_summary(quality.quality_report(spark, clean)).first()
    assert (summary.failed, summary.verdict) == (0, "accepted")


def test_duplicate_and_missing_accounts(spark, tables):
    assert [tuple(r) for r in quality.duplicate_accounts(tables["accounts"]).collect()] == [("b", 2)]
    present = table(spark, "accounts", dict(account_id="b"))
    assert [r.account_id for r in quality.missing_accounts(tables["accounts"], present).collect()] == [
        "a"
    ]


def test_playbook_gaps_and_score_range(spark):
    df = account_intelligence(recommended(spark, [{}, dict(computed_health_score=Decimal("100.01"))]))
    assert quality.playbook_gaps(df).count() == 0
    broken = df.withColumn("escalation_guidance", df.escalation_guidance.substr(1, 0))
    assert quality.playbook_gaps(broken).count() == 0
    from pyspark.sql import functions as F

    missing = df.withColumn("escalation_guidance", F.lit(None).cast("string")).withColumn(
        "suggested_owner_role", F.when(F.col("account_id") == "0", F.col("suggested_owner_role"))
    )
    found = {r.account_id: tuple(r)[2:] for r in quality.playbook_gaps(missing).collect()}
    assert found == {"0": (False, True), "1": (True, True)}
    row = quality.score_range(df).first()
    assert (row.max_health, row.min_health, row.rows_out_of_range) == (
        Decimal("100.01"),
        Decimal("51.50"),
        1,
    )
    assert [r.account_id for r in quality.scores_out_of_range(df).collect()] == ["1"]


def test_row_counts(tables):
    assert {r.table_name: r.row_count for r in quality.row_counts(tables).collect()} == {
        "accounts": 3,
        "actions": 5,
        "system_logs": 1,
    }


CSV = {
    "accounts": (
        "﻿account_id,company_name,industry,segment,company_size,annual_recurring_revenue,"
        "plan_type,customer_stage,account_owner,contract_start_date,renewal_date,created_at,updated_at\n"
        "a,Acme,FinTech,Startup,20,9506,Starter,At Risk,,2026-02-22,2027-02-22,2026-02-22,"
        "2026-06-28 15:06:25.874270\n"
    ),
    "actions": (
        "﻿action_id,account_id,recommended_action,assigned_to,priority,status,due_date,"
        "completed_at,outcome,created_at\n"
        'x,a,"Check, then call",Jo,Medium,Pending,2026-07-01,,,2026-06-24 16:04:15.921120\n'
    ),
}


def test_csv_with_byte_order_mark_and_short_timestamps(spark, tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}_sample.csv").write_text(text, encoding="utf-8")
    found = read_available_tables(spark, str(tmp_path), "csv", "_sample")
    assert set(found) == set(CSV)
    row = found["accounts"].first()
    assert (row.account_id, row.company_size, row.account_owner) == ("a", 20, None)
    assert row.annual_recurring_revenue == Decimal("9506.00")
    assert row.renewal_date == date(2027, 2, 22)
    assert str(row.created_at) == "2026-02-22 00:00:00"
    assert str(row.updated_at) == "2026-06-28 15:06:25.874270"
    action = found["actions"].first()
    assert action.recommended_action == "Check, then call" and action.completed_at is None
    assert quality.inputs_present(spark, found).where("status = 'FAIL'").count() == 6


def test_parquet_tables_conform_to_the_contract(spark, tmp_path):
    spark.sql("SELECT 'a' account_id, 7L company_size, 'x' extra").write.parquet(
        str(tmp_path / "accounts.parquet")
    )
    df = read_tables(spark, str(tmp_path), names=["accounts"])["accounts"]
    assert [f.dataType for f in df.schema] == [f.dataType for f in CONTRACTS["accounts"].schema]
    assert df.first().company_size == 7 and df.first().company_name is None


def test_written_table_goes_to_the_shared_checkpoint_folder(spark, tmp_path):
    df = account_labels(recommended(spark, [{}, {}]))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            write_between_stages(df, "labels")
        shared = str(tmp_path)
        spark.sparkContext.setCheckpointDir(shared)
    again = write_between_stages(df, "labels")
    assert again.schema.simpleString() == df.schema.simpleString()
    assert sorted(again.collect()) == sorted(df.collect())
    assert shared.removeprefix("file:").lstrip("/") in again.inputFiles()[0]


def test_relations_can_be_queried_by_name(spark):
    tables = {name: table(spark, name) for name in CONTRACTS}
    tables["accounts"] = table(spark, "accounts", dict(account_id="a", company_name="A"))
    Portfolio(tables, AS_OF).register()
    row = spark.sql(
        "SELECT computed_churn_risk_score, customer_priority_tier FROM account_intelligence_view"
    ).first()
    # 16 + 12 + 18 + 0 + 2.25 + 0 for an account nothing is known about.
    assert tuple(row) == (Decimal("48.25"), "Tier 4 - Monitor")
    assert spark.sql("SELECT total_accounts FROM dashboard_kpis").first()[0] == 1
    assert spark.table("dashboard_owner_workload").first().low_action_count == 1


def test_absent_tables_and_columns_are_findings_not_errors(spark, tables, tmp_path):
    for present in ({}, {"accounts": tables["accounts"]}, {"experiments": table(spark, "experiments")}):
        summary = quality.quality_summary(quality.quality_report(spark, present)).first()
        assert summary.verdict == "rejected"
    assert read_available_tables(spark, str(tmp_path), "parquet") == {}
    for check in (quality.primary_keys, quality.foreign_key_orphans, quality.critical_nulls, quality.not_null):
        assert check(spark, {}).count() == 0


def test_a_table_without_its_key_fails(spark, tables, tmp_path):
    tables["actions"].drop("account_id", "action_id").write.parquet(f"{tmp_path}/actions.parquet")
    tables["accounts"].write.parquet(f"{tmp_path}/accounts.parquet")
    read = read_available_tables(spark, str(tmp_path), "parquet")
    plain = {**tables, "actions": tables["actions"].drop("account_id", "action_id")}
    for found in (read, plain):
        missing = quality.missing_columns(spark, found).collect()
        assert {(r.table_name, r.metric, r.status) for r in missing} >= {
            ("actions", "account_id", "FAIL"),
            ("actions", "action_id", "FAIL"),
        }
        orphans = quality.foreign_key_orphans(spark, found).where("table_name = 'actions'").first()
        assert (orphans.orphan_ids, orphans.null_ids, orphans.status) == (0, 5, "FAIL")
        keys = quality.primary_keys(spark, found).where("table_name = 'actions'").first()
        assert (keys.null_keys, keys.status) == (5, "FAIL")
        assert quality.quality_summary(quality.quality_report(spark, found)).first().verdict == "rejected"


def test_not_null(spark, tables):
    found = {(r.table_name, r.column_name): (r.null_count, r.status) for r in quality.not_null(spark, tables).collect()}
    assert found["accounts", "company_name"] == (1, "FAIL")
    assert found["accounts", "account_id"] == (0, "PASS")
    assert found["actions", "action_id"] == (2, "FAIL")


def csv_file(tmp_path, text: str) -> str:
    path = tmp_path / "accounts.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_columns_go_by_name(spark, tmp_path):
    path = csv_file(
        tmp_path,
        "\ufeffcompany_name,account_owner,account_id,annual_recurring_revenue,unknown\n"
        '"Acme\nWorks, ""the"" one",Ann,a,12.50,x\n',
    )
    rows = read_csv_table(spark, path, CONTRACTS["accounts"])
    row = rows.first()
    assert (row.account_id, row.company_name, row.account_owner) == ("a", 'Acme\nWorks, "the" one', "Ann")
    assert row.annual_recurring_revenue == Decimal("12.50") and row.company_size is None
    absent = absent_columns(rows, CONTRACTS["accounts"])
    assert "company_size" in absent and "account_id" not in absent
    assert rows.columns == [name for name, _ in CONTRACTS["accounts"].columns]


def test_csv_rejects(spark, tmp_path):
    path = csv_file(
        tmp_path,
        "account_id,company_name,company_size,renewal_date\n"
        "a,Acme,12,2026-01-02\n"
        "b,Bolt,many,2026-01-02\n"
        "c,Cog,5,soon\n"
        "d,Dot,5\n"
        "e,Egg,,\n",
    )
    good, rejects = split_csv_table(spark, path, CONTRACTS["accounts"])
    assert [r.account_id for r in good.orderBy("account_id").collect()] == ["a", "e"]
    bad = {r.account_id: (r.bad_columns, r[CORRUPT]) for r in rejects.collect()}
    assert bad["b"] == (["company_size"], None) and bad["c"] == (["renewal_date"], None)
    assert bad["d"][1] == "d,Dot,5"


BROKEN = (
    "account_id,company_name,company_size,annual_recurring_revenue\n"
    "a,Acme,12,9.50\n"
    "b,Bolt,12,12k\n"  # a bad cell
    "c,Cog,5\n"  # a short row
    "d,Dot,5,1.00,more\n"  # a long row
    '"e","Egg\n& Co",,2\n'
)


@pytest.fixture
def checkpoints(spark, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))


@pytest.mark.parametrize("file_format", ["csv", "csv-staged"])
def test_no_csv_row_is_lost_unseen(spark, tmp_path, checkpoints, file_format):
    csv_file(tmp_path, BROKEN)
    found = read_tables(spark, str(tmp_path), file_format, names=["accounts"])
    rows = {r.account_id: r for r in found["accounts"].collect()}
    assert set(rows) == {"a", "e"} and rows["e"].company_name == "Egg\n& Co"
    assert rows["a"].annual_recurring_revenue == Decimal("9.50") and rows["a"].industry is None
    assert "industry" in absent_columns(found["accounts"], CONTRACTS["accounts"])
    assert [f.dataType for f in found["accounts"].schema] == [f.dataType for f in CONTRACTS["accounts"].schema]
    rejects = {r.account_id: r for r in found.rejects["accounts"].collect()}
    assert set(rejects) == {"b", "c", "d"}
    assert (rejects["b"].bad_columns, rejects["b"].annual_recurring_revenue) == (["annual_recurring_revenue"], "12k")
    assert rejects["c"][CORRUPT] == "c,Cog,5" and rejects["d"][CORRUPT] == "d,Dot,5,1.00,more"
    report = quality.quality_report(spark, found).where("table_name = 'accounts'")
    checks = {(r.check, r.value, r.status) for r in report.collect() if "row" in r.check}
    assert checks == {("rejected_rows", 3, "FAIL"), ("rows_in_file", 5, "PASS")}
    assert quality.quality_summary(report).first().verdict == "rejected"


def test_a_clean_csv_file_rejects_nothing(spark, tmp_path, checkpoints):
    csv_file(tmp_path, "account_id,company_name\na,Acme\n")
    for file_format in ("csv", "csv-staged"):
        found = read_tables(spark, str(tmp_path), file_format, names=["accounts"])
        assert found.rejects["accounts"].count() == 0
        report = quality.quality_report(spark, found).collect()
        assert [(r.value, r.status) for r in report if r.check == "rejected_rows"] == [(0, "PASS")]
    assert "rejected_rows" not in {r.check for r in quality.quality_report(spark, dict(found)).collect()}


def test_staged_csv_is_parsed_once(spark, tmp_path, checkpoints):
    path = csv_file(tmp_path, BROKEN)
    good, rejects = stage_csv_table(spark, path, CONTRACTS["accounts"])
    for df in (good.select("account_id"), rejects):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in text and "csv" not in text.lower().replace("accounts.csv", "")
    assert "company_name" not in good.select("account_id")._jdf.queryExecution().executedPlan().toString()


def test_summary_of_one_read_is_that_of_the_single_checks(spark, tables):
    tables = {**tables, "experiments": table(spark, "experiments")}
    rows = {r.table_name: r for r in quality.table_summary(spark, tables).collect()}
    assert set(rows) == set(tables)
    for facts in quality.table_facts(spark, tables).collect():
        own = rows[facts.table_name]
        assert (own.row_count, own.null_keys, own.duplicate_keys) == tuple(facts)[1:]
    for r in quality.not_null(spark, tables).collect():
        assert (rows[r.table_name].null_counts or {}).get(r.column_name, 0) == r.null_count
    for r in quality.foreign_key_orphans(spark, tables).collect():
        assert (rows[r.table_name].orphan_ids, rows[r.table_name].null_ids) == (r.orphan_ids, r.null_ids)
    assert any(r.orphan_ids for r in rows.values()) and any(r.null_counts for r in rows.values())
    assert {r.rejected_rows for r in rows.values()} == {0}
