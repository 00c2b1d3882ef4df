from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import functions as F
from test_actions_and_labels import recommended

from tallyscope.operators import scoring as S
from tallyscope.operators.explain import (
    GUARDRAIL_NOTE,
    accepted_and_rejected,
    explanation_context,
    parse_explanations,
)
from tallyscope.operators.intelligence import account_intelligence


def test_document_layout(spark):
    df = account_intelligence(recommended(spark, [dict(account_owner=None, nps_score=None)]))
    row = df.first()
    lines = explanation_context(df).first().context_text.split("\n")
    assert lines[:6] == [
        "ACCOUNT CONTEXT (pre-computed by PostgreSQL scoring and action playbook engine):",
        "",
        "ACCOUNT PROFILE:",
        "  Company:            Acme",
        "  Industry:           FinTech",
        "  Segment:            Startup",
    ]
    assert "  Account Owner:      —" in lines
    assert "  NPS Score:             —" in lines
    assert "  Health Score:          51.50  (Weak)" in lines
    assert "  Human Review Required: No" in lines
    assert "  Review Reason:         No manual review required based on current rules." in lines
    start = lines.index("PHASE 2 FOLLOW-UP STEPS (pre-determined):")
    assert lines[start - 1] == ""
    assert lines[start + 1 : start + 5] == [
        f"  {n}. {text}" for n, text in enumerate(row.phase_2_next_steps, 1)
    ]
    assert lines[-1] == f"  {row.escalation_guidance}"
    first = next(n for n, line in enumerate(lines) if line.startswith("IMMEDIATE STEPS"))
    assert lines[first + 4] == "  4. None"


def test_absent_blocks_are_left_out(spark):
    df = account_intelligence(recommended(spark, [{}])).withColumns(
        {
            "phase_2_next_steps": F.array().cast("array<string>"),
            "success_metrics": F.lit(None).cast("array<string>"),
            "recommended_next_action": F.lit(""),
            "human_review_reason": F.lit(None).cast("string"),
        }
    )
    text = explanation_context(df).first().context_text
    for gone in ("PHASE 2", "SUCCESS METRICS", "NEXT ACTION", "Review Reason"):
        assert gone not in text
    assert "IMMEDIATE STEPS" in text and "ESCALATION GUIDANCE" in text and "\n\n\n" not in text


def test_stored_answers(spark):
    good = {
        "ai_summary": "fine",
        "confidence_note": "sure",
        "key_signal_drivers": [
            {"signal": "Usage", "value": 12, "interpretation": "low"},
            "stray",
            7,
            {"signal": "Flag", "value": True},
            {"value": None},
            {},
            {"signal": "Text", "value": "{3}"},
        ],
        "extra": [1],
    }
    answers = {
        "good": json.dumps(good),
        "no drivers": "{}",
        "not json": "Sorry, I cannot",
        "list": "[1]",
        "number": "3",
        "drivers text": '{"key_signal_drivers": "x"}',
        "drivers null": '{"key_signal_drivers": null}',
        "summary number": '{"ai_summary": 5}',
        "signal number": '{"key_signal_drivers": [{"signal": 5}]}',
        "missing": None,
    }
    df = spark.createDataFrame(list(answers.items()), "account_id string, response_json string")
    accepted, rejected = accepted_and_rejected(parse_explanations(df))
    kept = {r.account_id: r for r in accepted.collect()}
    assert set(kept) == {"good", "no drivers"}
    row = kept["good"]
    assert (row.ai_summary, row.recommended_next_step, row.confidence_note) == ("fine", "", "sure")
    assert row.guardrail_note == GUARDRAIL_NOTE
    assert [tuple(d) for d in row.key_signal_drivers] == [
        ("Usage", "12", "low"),
        ("Flag", "True", ""),
        ("", "None", ""),
        ("", "", ""),
        ("Text", "{3}", ""),
    ]
    assert kept["no drivers"].key_signal_drivers == []
    why = {r.account_id: r.parse_error for r in rejected.collect()}
    assert why == {
        "not json": "not JSON",
        "missing": "not JSON",
        "list": "not an object",
        "number": "not an object",
        "drivers text": "drivers are not a list",
        "drivers null": "drivers are not a list",
        "summary number": "text expected",
        "signal number": "text expected",
    }


QUIET_DOCUMENT = """\
ACCOUNT CONTEXT (pre-computed by PostgreSQL scoring and action playbook engine):

ACCOUNT PROFILE:
  Company:            Acme
  Industry:           FinTech
  Segment:            Startup
  Plan Type:          Starter
  Account Owner:      —
  Days Until Renewal: 123

COMPUTED SCORES (ground truth — do not recalculate):
  Health Score:          51.50  (Weak)
  Churn Risk Score:      41.00  (Watch)
  Expansion Score:       61.25  (Expansion Possible)

CLASSIFICATION (ground truth — do not override):
  Risk Level:            Low Risk
  Expansion Level:       Low Expansion
  Priority Tier:         Tier 4 - Monitor
  Business Motion:       Monitor

BEHAVIORAL SIGNALS (last 30 days):
  Usage Events:          20
  Active Users:          17
  Support Tickets:       2
  NPS Score:             —
  Overdue Actions:       1

DETERMINISTIC ACTION PLAN (do not alter — explain why this plan fits the signals above):
  Action Type:           Monitor Account
  Priority:              Low
  Suggested Owner:       Revenue Operations
  Due Date:              2024-03-06
  Timeline:              30-day monitoring cycle
  Recommendation Reason: Account currently has low urgency with health score of 51.50, churn risk score of 41.00, and expansion score of 61.25.
  Human Review Required: No
  Review Reason:         No manual review required based on current rules.

NEXT ACTION (pre-determined — do not replace):
  No immediate action required. Continue monitoring account health, usage, support pressure, and renewal timing.

IMMEDIATE STEPS (pre-determined — explain why these fit the signals, do not invent alternatives):
  1. Check (Monitor Account)
  2. Discuss (usage events: 20, active users: 17)
  3. Decide (support tickets: 2)
  4. None
  5. Confirm (Monitor Account)

PHASE 2 FOLLOW-UP STEPS (pre-determined):
  1. Review again (Monitor Account)
  2. Report (Monitor Account)
  3. Adjust (Monitor Account)
  4. Close or renew (Monitor Account)

SUCCESS METRICS (pre-determined — explain what each measures and why it matters):
  1. First measure (Monitor Account)
  2. Second measure (overdue actions: 1)
  3. Third measure (Monitor Account)
  4. Fourth measure (Monitor Account)

ESCALATION GUIDANCE (pre-determined):
  Escalate if it gets worse (Monitor Account)"""
URGENT_DOCUMENT = """\
ACCOUNT CONTEXT (pre-computed by PostgreSQL scoring and action playbook engine):

ACCOUNT PROFILE:
  Company:            Acme
  Industry:           FinTech
  Segment:            Startup
  Plan Type:          Starter
  Account Owner:      Ann
  Days Until Renewal: 20

COMPUTED SCORES (ground truth — do not recalculate):
  Health Score:          51.50  (Weak)
  Churn Risk Score:      72.25  (Immediate Risk)
  Expansion Score:       61.25  (Expansion Possible)

CLASSIFICATION (ground truth — do not override):
  Risk Level:            Critical Risk
  Expansion Level:       Low Expansion
  Priority Tier:         Tier 1 - Save Immediately
  Business Motion:       Save

BEHAVIORAL SIGNALS (last 30 days):
  Usage Events:          20
  Active Users:          17
  Support Tickets:       6
  NPS Score:             6
  Overdue Actions:       1

DETERMINISTIC ACTION PLAN (do not alter — explain why this plan fits the signals above):
  Action Type:           Executive Renewal Save Plan
  Priority:              Critical
  Suggested Owner:       Customer Success Leadership
  Due Date:              2024-02-06
  Timeline:              URGENT — within 24 hours
  Recommendation Reason: High churn risk score of 72.25, health score of 51.50, 20 days until renewal, 20 usage events in the last 30 days, 6 support tickets, and 1 overdue actions.
  Human Review Required: Yes
  Review Reason:         Critical recommended action requires leadership review.

NEXT ACTION (pre-determined — do not replace):
  Schedule an executive renewal save call, review product issues, confirm renewal blockers, and create a save plan within 24 hours.

IMMEDIATE STEPS (pre-determined — explain why these fit the signals, do not invent alternatives):
  1. Check (days until renewal: 20)
  2. Discuss (a renewal within a month)
  3. Decide (support tickets: 6)
  4. Assign (a renewal within a month)
  5. Confirm (a renewal within a month)

PHASE 2 FOLLOW-UP STEPS (pre-determined):
  1. Review again (Executive Renewal Save Plan)
  2. Report (Executive Renewal Save Plan)
  3. Adjust (Executive Renewal Save Plan)
  4. Close or renew (Executive Renewal Save Plan)

SUCCESS METRICS (pre-determined — explain what each measures and why it matters):
  1. First measure (Executive Renewal Save Plan)
  2. Second measure (Executive Renewal Save Plan)
  3. Third measure (Executive Renewal Save Plan)
  4. Fourth measure (Executive Renewal Save Plan)

ESCALATION GUIDANCE (pre-determined):
  Escalate if it gets worse (Executive Renewal Save Plan)"""


def test_whole_documents(spark):
    urgent = dict(
        customer_priority_tier_v3=S.SAVE_IMMEDIATELY,
        computed_churn_risk_score=Decimal("72.25"),
        risk_level_v2="Critical Risk",
        days_until_renewal=20,
        support_tickets_last_30_days=6,
    )
    df = account_intelligence(recommended(spark, [dict(account_owner=None, nps_score=None), urgent]))
    found = [r.context_text for r in explanation_context(df).orderBy("account_id").collect()]
    assert found == [QUIET_DOCUMENT, URGENT_DOCUMENT]
