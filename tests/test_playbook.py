from __future__ import annotations

import re
from datetime import date
from decimal import Decimal

import pytest
from conftest import frame, values

from tallyscope.operators.playbook import action_playbook, playbook_signals, playbook_steps
from tallyscope.plans.playbook_content import PLAYS, Branch, plays_from_table

TYPES = dict(
    company_name="string",
    recommended_action_type="string",
    recommended_action_priority="string",
    computed_churn_risk_score="decimal(5,2)",
    computed_health_score="decimal(5,2)",
    computed_expansion_score="decimal(5,2)",
    support_tickets_last_30_days="int",
    usage_events_last_30_days="bigint",
    active_users_last_30_days="bigint",
    overdue_action_count="bigint",
    nps_score="int",
    days_until_renewal="int",
    risk_level_v2="string",
    expansion_level_v2="string",
    customer_priority_tier_v3="string",
    suggested_owner_role="string",
    recommended_due_date="date",
    account_owner="string",
)
# Every signal off.
QUIET = dict(
    company_name="Acme",
    recommended_action_type="Monitor Account",
    recommended_action_priority="Low",
    computed_churn_risk_score=Decimal("41.00"),
    computed_health_score=Decimal("51.50"),
    computed_expansion_score=Decimal("61.25"),
    support_tickets_last_30_days=2,
    usage_events_last_30_days=20,
    active_users_last_30_days=17,
    overdue_action_count=1,
    nps_score=6,
    days_until_renewal=123,
    risk_level_v2="Low Risk",
    expansion_level_v2="Low Expansion",
    customer_priority_tier_v3="Tier 4 - Monitor",
    suggested_owner_role="Revenue Operations",
    recommended_due_date=date(2024, 3, 6),
    account_owner="Ann",
)
ON = dict(
    high_support=dict(support_tickets_last_30_days=9),
    low_usage=dict(usage_events_last_30_days=15),
    high_usage=dict(usage_events_last_30_days=50),
    low_nps=dict(nps_score=5),
    renewal_imminent=dict(days_until_renewal=30),
    renewal_near=dict(days_until_renewal=90),
    very_high_churn=dict(computed_churn_risk_score=Decimal("60.00")),
    healthy=dict(computed_health_score=Decimal("65.00")),
    strong_expansion=dict(computed_expansion_score=Decimal("65.00")),
    has_overdue=dict(overdue_action_count=2),
)
FILLS = dict(
    tickets="support_tickets_last_30_days",
    usage="usage_events_last_30_days",
    users="active_users_last_30_days",
    overdue="overdue_action_count",
    nps="nps_score",
    days="days_until_renewal",
    health="computed_health_score",
    churn="computed_churn_risk_score",
    exp="computed_expansion_score",
    owner="account_owner",
    role="suggested_owner_role",
    due="recommended_due_date",
)


def rows(spark, cases):
    return frame(spark, TYPES, QUIET, cases)


def written(template: str, case: dict) -> str:
    row = {**QUIET, **case}
    return template.format(**{name: str(row[column]) for name, column in FILLS.items()})


def test_signals_at_their_edges_and_unknown(spark):
    on = [change for changes in ON.values() for change in [changes]]
    df = playbook_signals(rows(spark, [{}, *on, dict(nps_score=None, days_until_renewal=None)]))
    assert not any(values(df, *ON)[0])
    for place, name in enumerate(ON, 1):
        assert values(df, name)[place] is True, name
    unknown = df.where(f"account_id = '{len(on) + 1}'").first()
    assert unknown.low_nps is None and unknown.high_nps is None and unknown.renewal_near is None
    edges = rows(
        spark,
        [
            dict(support_tickets_last_30_days=3, active_users_last_30_days=5, nps_score=8),
            dict(support_tickets_last_30_days=4, active_users_last_30_days=6, nps_score=7),
            dict(support_tickets_last_30_days=5),
        ],
    )
    found = values(playbook_signals(edges), "moderate_support", "very_low_users", "high_nps")
    assert found == [(True, True, True), (True, False, False), (False, False, False)]


def branch_cases():
    """A row for each branch: its own signals on, all others off."""
    for play in PLAYS:
        for branch in play.branches:
            case = dict(recommended_action_type=play.action_type or "Something new")
            for signal in branch.signals:
                case |= ON[signal]
            yield play, branch, case


def test_every_branch_and_its_texts(spark):
    picked = list(branch_cases())
    assert len(picked) == 33
    df = action_playbook(rows(spark, [case for _, _, case in picked]))
    found = values(
        df,
        "immediate_next_steps",
        "phase_2_next_steps",
        "success_metrics",
        "escalation_guidance",
    )
    for (play, branch, case), (steps, later, metrics, escalation) in zip(picked, found, strict=True):
        assert steps == [written(t, case) for t in branch.steps]
        assert later == [written(t, case) for t in play.phase_2]
        assert metrics == [written(t, case) for t in play.metrics]
        assert escalation == written(play.escalation, case)


# Values shown by each immediate step, branch after branch; a dot is fixed text.
SHOWN = """
tickets . users role . / tickets . . . days / users+usage . . . . / role tickets+usage+owner . days .
days . tickets . . / days . . . role / . health+churn+tickets . . .
tickets nps . . . / nps . . . role / tickets . . . . / owner usage+users . . role
days . tickets . role / days . . . tickets / owner health+usage+nps . . .
days+churn . . . role / days . tickets . role / owner+churn usage+tickets+nps . role .
days . . usage+users role / . health+exp+nps . . role
exp+usage . . . . / exp . . . role
usage . . . . / exp . . . . / usage . . nps .
overdue owner usage nps . / owner usage nps exp . / owner+health usage+users tickets nps .
overdue tickets owner . . / overdue . . . . / . usage+users tickets owner .
days . usage . . / days owner usage+tickets+nps . .
owner health+churn . due role
"""


def test_each_step_shows_the_values_it_should():
    for play, line in zip(PLAYS, SHOWN.strip().split("\n"), strict=True):
        for branch, steps in zip(play.branches, line.split(" / "), strict=True):
            shown = [set(re.findall(r"{(\w+)}", step)) for step in branch.steps]
            expected = [set() if s == "." else set(s.split("+")) for s in steps.split()]
            assert shown == expected, (play.action_type, branch.signals)


def test_later_lists_show_the_values_they_should():
    def shown(texts):
        return {n: set(re.findall(r"{(\w+)}", t)) for n, t in enumerate(texts, 1) if "{" in t}

    phase_2 = {p.action_type: shown(p.phase_2) for p in PLAYS if shown(p.phase_2)}
    assert phase_2 == {
        "Expansion Discovery": {4: {"role"}},
        "Maintain Account Health": {4: {"role"}},
        None: {1: {"owner"}, 4: {"role"}},
    }
    metrics = {p.action_type: shown(p.metrics) for p in PLAYS if shown(p.metrics)}
    assert metrics == {
        "Immediate Churn Intervention": {1: {"churn"}, 2: {"health"}, 4: {"usage"}},
        "CSM Risk Review": {1: {"nps"}, 3: {"usage"}},
        "Expansion Nurture": {1: {"exp"}, 4: {"nps"}},
        "Maintain Account Health": {1: {"health"}},
        "Monitor Account": {2: {"overdue"}},
        None: {1: {"owner"}},
    }
    assert [p.action_type for p in PLAYS if "{" in p.escalation] == [None]


def test_earlier_branches_win(spark):
    every_signal = {k: v for change in ON.values() for k, v in change.items()}
    every_signal |= dict(days_until_renewal=5, usage_events_last_30_days=99)
    cases = [
        dict(every_signal, recommended_action_type=play.action_type or "?") for play in PLAYS
    ]
    # Usage cannot be low and high at once: with high usage the churn play takes its second branch.
    firsts = [play.branches[0] for play in PLAYS]
    firsts[0] = PLAYS[0].branches[1]
    found = values(action_playbook(rows(spark, cases)), "immediate_next_steps")
    for branch, case, steps in zip(firsts, cases, found, strict=True):
        assert steps == [written(t, case) for t in branch.steps]


def test_unknown_number_blanks_its_step_only(spark):
    case = dict(
        recommended_action_type="Expansion Nurture", nps_score=None, usage_events_last_30_days=20
    )
    row = action_playbook(rows(spark, [case])).first()
    assert [step is None for step in row.immediate_next_steps] == [False, False, False, True, False]
    assert [metric is None for metric in row.success_metrics] == [False, False, False, True]
    no_owner = action_playbook(rows(spark, [dict(account_owner=None)])).first()
    assert [step is None for step in no_owner.immediate_next_steps] == [
        False,
        False,
        False,
        True,
        False,
    ]


def test_default_play_names_the_date_or_says_tbd(spark):
    cases = [dict(recommended_action_type=None), dict(recommended_action_type="?", recommended_due_date=None)]
    found = values(action_playbook(rows(spark, cases)), "immediate_next_steps", "timeline_label")
    assert found[0][0][3] == "Assign (due: 2024-03-06)" and found[1][0][3] == "Assign (due: TBD)"
    assert found[0][1] == "Review within 2 weeks"


def test_values_are_not_read_as_templates(spark):
    row = action_playbook(rows(spark, [dict(account_owner="{role} 'n \\ co")])).first()
    assert "{role} 'n \\ co" in row.immediate_next_steps[3]


def test_timelines(spark):
    expected = [
        ("Immediate Churn Intervention", {**ON["very_high_churn"], **ON["renewal_near"]}, "CRITICAL — within 24 hours"),
        ("Immediate Churn Intervention", ON["very_high_churn"], "Immediate — within 48 hours"),
        ("Executive Renewal Save Plan", ON["renewal_imminent"], "URGENT — within 24 hours"),
        ("Executive Renewal Save Plan", ON["renewal_near"], "Urgent — within 1 week"),
        ("Executive Renewal Save Plan", dict(days_until_renewal=None), "High priority — within 2 weeks"),
        ("CSM Risk Review", {**ON["low_nps"], **ON["high_support"]}, "Urgent — within 1 week"),
        ("CSM Risk Review", ON["low_nps"], "Within 1–2 weeks"),
        ("Renewal Readiness Review", ON["renewal_imminent"], "URGENT — this week"),
        ("Renewal Readiness Review", ON["renewal_near"], "Within 2 weeks"),
        ("Renewal Readiness Review", {}, "Within 30 days"),
        ("Renewal Risk Review", {**ON["renewal_imminent"], **ON["very_high_churn"]}, "CRITICAL — within 24 hours"),
        ("Renewal Risk Review", ON["renewal_imminent"], "Immediate — within 48 hours"),
        ("Renewal Risk Review", ON["renewal_near"], "Within 1 week"),
        ("Renewal and Expansion Review", ON["renewal_imminent"], "URGENT — this week"),
        ("Renewal and Expansion Review", ON["renewal_near"], "Within 2 weeks"),
        ("Renewal and Expansion Review", {}, "This quarter"),
        ("Expansion Discovery", {}, "Within 30 days"),
        ("Expansion Nurture", {}, "30–60 day nurture cycle"),
        ("Maintain Account Health", {}, "Ongoing — quarterly cadence"),
        ("Monitor Account", {}, "30-day monitoring cycle"),
        ("Renewal Monitoring", ON["renewal_imminent"], "Within 48 hours of renewal date"),
        ("Renewal Monitoring", {}, "Monthly checkpoint"),
    ]
    df = action_playbook(
        rows(spark, [dict(case, recommended_action_type=kind) for kind, case, _ in expected])
    )
    assert values(df, "timeline_label") == [label for _, _, label in expected]


def test_steps_are_numbered_per_list(spark):
    df = playbook_steps(action_playbook(rows(spark, [{}])))
    found = {(r.list_name, r.step_number): r.step_text for r in df.collect()}
    assert len(found) == 13
    assert found["success_metrics", 2] == "Second measure (overdue actions: 1)"


def test_own_wording_can_replace_the_default(spark):
    plain = tuple(
        play._replace(branches=(Branch((), ("Call {owner}",) * 5),), escalation="Ask {role}")
        for play in PLAYS
    )
    row = action_playbook(rows(spark, [{}]), plain).first()
    assert row.immediate_next_steps == ["Call Ann"] * 5
    assert row.escalation_guidance == "Ask Revenue Operations"


TABLE = "action_type string, signals string, list string, position int, text string"


def test_wording_from_a_table(spark):
    wording = spark.createDataFrame(
        [
            ("Monitor Account", None, "immediate", 1, "Call {owner} of this quiet account"),
            ("Monitor Account", "has_overdue", "immediate", 2, "Clear {overdue} tasks"),
            ("Monitor Account", "", "metrics", 4, "Fourth"),
            ("Monitor Account", "", "escalation", 1, "Ask {role}"),
            (None, "", "phase_2", 2, "Later"),
        ],
        TABLE,
    )
    plays = plays_from_table(wording)
    quiet, late = values(
        action_playbook(rows(spark, [{}, ON["has_overdue"]]), plays),
        "immediate_next_steps",
        "success_metrics",
        "escalation_guidance",
    )
    assert quiet[0][0] == "Call Ann of this quiet account" and quiet[0][1] != "Clear 1 tasks"
    assert late[0][1] == "Clear 2 tasks" and late[0][0] == PLAYS[9].branches[1].steps[0].format(overdue=2)
    assert quiet[1][3] == late[1][3] == "Fourth" and quiet[2] == "Ask Revenue Operations"
    other = action_playbook(rows(spark, [dict(recommended_action_type="?")]), plays).first()
    assert other.phase_2_next_steps[1] == "Later"


@pytest.mark.parametrize(
    "row",
    [
        ("Monitor Account", "", "immediate", 6, "too far"),
        ("Monitor Account", "", "later", 1, "no such list"),
        ("Monitor Account", "low_nps", "immediate", 1, "no such branch"),
        ("No such play", "", "immediate", 1, "text"),
        ("Monitor Account", "", "immediate", 1, "no {such} value"),
        ("Monitor Account", "", "immediate", 1, None),
    ],
)
def test_wording_that_fits_nowhere_is_an_error(spark, row):
    with pytest.raises(ValueError):
        plays_from_table(spark.createDataFrame([row], TABLE))
