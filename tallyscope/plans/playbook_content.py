"""The action playbook as data: its rules, a short default wording, and reading other wordings.

What the rules fix is which branch applies, how many entries each list has, which of the account's
values each entry shows, and the timeline labels. Wording is the user's: ``plays_from_table`` reads
it from a table. The default says no more than the signals and the values mean.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Branch(NamedTuple):
    """``steps`` apply when all ``signals`` hold; the last branch of a play has none."""

    signals: tuple[str, ...]
    steps: tuple[str, ...]


class Play(NamedTuple):
    """``timeline`` holds ``(signals, label)`` pairs tried in order, the last without signals."""

    action_type: str | None
    branches: tuple[Branch, ...]
    phase_2: tuple[str, ...]
    metrics: tuple[str, ...]
    escalation: str
    timeline: tuple[tuple[tuple[str, ...], str], ...]


class Rule(NamedTuple):
    """A play without words: values shown by each entry, in order, joined by ``+``; none is ``.``."""

    action_type: str | None
    branches: tuple[tuple[str, str], ...]  # signals, values of the five steps
    timeline: tuple[tuple[str, str], ...]  # signals, label
    phase_2: str = ". . . ."
    metrics: str = ". . . ."
    escalation: str = "."


#: Branch order and conditions, values shown by place, timeline labels.
RULES = (
    Rule(
        "Immediate Churn Intervention",
        (
            ("high_support low_usage", "tickets . users role ."),
            ("high_support", "tickets . . . days"),
            ("low_usage", "users+usage . . . ."),
            ("", "role tickets+usage+owner . days ."),
        ),
        (
            ("very_high_churn renewal_near", "CRITICAL — within 24 hours"),
            ("", "Immediate — within 48 hours"),
        ),
        metrics="churn health . usage",
    ),
    Rule(
        "Executive Renewal Save Plan",
        (
            ("renewal_imminent", "days . tickets . ."),
            ("renewal_near", "days . . . role"),
            ("", ". health+churn+tickets . . ."),
        ),
        (
            ("renewal_imminent", "URGENT — within 24 hours"),
            ("renewal_near", "Urgent — within 1 week"),
            ("", "High priority — within 2 weeks"),
        ),
    ),
    Rule(
        "CSM Risk Review",
        (
            ("high_support low_nps", "tickets nps . . ."),
            ("low_nps", "nps . . . role"),
            ("high_support", "tickets . . . ."),
            ("", "owner usage+users . . role"),
        ),
        (("low_nps high_support", "Urgent — within 1 week"), ("", "Within 1–2 weeks")),
        metrics="nps . usage .",
    ),
    Rule(
        "Renewal Readiness Review",
        (
            ("renewal_imminent", "days . tickets . role"),
            ("renewal_near", "days . . . tickets"),
            ("", "owner health+usage+nps . . ."),
        ),
        (
            ("renewal_imminent", "URGENT — this week"),
            ("renewal_near", "Within 2 weeks"),
            ("", "Within 30 days"),
        ),
    ),
    Rule(
        "Renewal Risk Review",
        (
            ("renewal_imminent very_high_churn", "days+churn . . . role"),
            ("renewal_imminent", "days . tickets . role"),
            ("", "owner+churn usage+tickets+nps . role ."),
        ),
        (
            ("renewal_imminent very_high_churn", "CRITICAL — within 24 hours"),
            ("renewal_imminent", "Immediate — within 48 hours"),
            ("", "Within 1 week"),
        ),
    ),
    Rule(
        "Renewal and Expansion Review",
        (
            ("renewal_imminent strong_expansion", "days . . usage+users role"),
            ("", ". health+exp+nps . . role"),
        ),
        (
            ("renewal_imminent", "URGENT — this week"),
            ("renewal_near", "Within 2 weeks"),
            ("", "This quarter"),
        ),
    ),
    Rule(
        "Expansion Discovery",
        (("strong_expansion high_usage", "exp+usage . . . ."), ("", "exp . . . role")),
        (("", "Within 30 days"),),
        phase_2=". . . role",
    ),
    Rule(
        "Expansion Nurture",
        (
            ("high_usage strong_expansion", "usage . . . ."),
            ("strong_expansion", "exp . . . ."),
            ("", "usage . . nps ."),
        ),
        (("", "30–60 day nurture cycle"),),
        metrics="exp . . nps",
    ),
    Rule(
        "Maintain Account Health",
        (
            ("has_overdue", "overdue owner usage nps ."),
            ("high_usage healthy", "owner usage nps exp ."),
            ("", "owner+health usage+users tickets nps ."),
        ),
        (("", "Ongoing — quarterly cadence"),),
        phase_2=". . . role",
        metrics="health . . .",
    ),
    Rule(
        "Monitor Account",
        (
            ("has_overdue high_support", "overdue tickets owner . ."),
            ("has_overdue", "overdue . . . ."),
            ("", ". usage+users tickets owner ."),
        ),
        (("", "30-day monitoring cycle"),),
        metrics=". overdue . .",
    ),
    Rule(
        "Renewal Monitoring",
        (("renewal_imminent", "days . usage . ."), ("", "days owner tickets+nps+usage . .")),
        (("renewal_imminent", "Within 48 hours of renewal date"), ("", "Monthly checkpoint")),
    ),
    Rule(
        None,
        (("", "owner health+churn . due role"),),
        (("", "Review within 2 weeks"),),
        phase_2="owner . . role",
        metrics="owner . . .",
        escalation="role",
    ),
)

SHOWN = {
    "tickets": "support tickets: {tickets}",
    "usage": "usage events: {usage}",
    "users": "active users: {users}",
    "overdue": "overdue actions: {overdue}",
    "nps": "NPS: {nps}",
    "days": "days until renewal: {days}",
    "health": "health score: {health}",
    "churn": "churn risk score: {churn}",
    "exp": "expansion score: {exp}",
    "owner": "account owner: {owner}",
    "role": "responsible: {role}",
    "due": "due: {due}",
}
MEANING = {
    "high_support": "many support tickets",
    "low_usage": "low usage",
    "high_usage": "high usage",
    "low_nps": "a low NPS",
    "renewal_imminent": "a renewal within a month",
    "renewal_near": "a renewal within a quarter",
    "very_high_churn": "a very high churn risk",
    "healthy": "good health",
    "strong_expansion": "strong expansion",
    "has_overdue": "overdue actions",
}
STEP_KINDS = ("Check", "Discuss", "Decide", "Assign", "Confirm")
LATER_KINDS = ("Review again", "Report", "Adjust", "Close or renew")
METRIC_KINDS = ("First measure", "Second measure", "Third measure", "Fourth measure")


def _entry(kind: str, values: str, about: str) -> str:
    """What to do, and the values to do it with or else what it is about."""
    shown = about if values == "." else ", ".join(SHOWN[name] for name in values.split("+"))
    return f"{kind} ({shown})"


def _entries(kinds: tuple[str, ...], values: str, about: str) -> tuple[str, ...]:
    return tuple(_entry(kind, v, about) for kind, v in zip(kinds, values.split(), strict=True))


def worded(rule: Rule) -> Play:
    """A play in the default wording."""
    about = rule.action_type or "the account"
    branches = []
    for signals, values in rule.branches:
        names = tuple(signals.split())
        cause = " and ".join(MEANING[name] for name in names) or about
        branches.append(Branch(names, _entries(STEP_KINDS, values, cause)))
    return Play(
        rule.action_type,
        tuple(branches),
        _entries(LATER_KINDS, rule.phase_2, about),
        _entries(METRIC_KINDS, rule.metrics, about),
        _entry("Escalate if it gets worse", rule.escalation, about),
        tuple((tuple(signals.split()), label) for signals, label in rule.timeline),
    )


PLAYS: tuple[Play, ...] = tuple(map(worded, RULES))

#: Lists of a playbook table, and how many entries each has.
LISTS = {"immediate": 5, "phase_2": 4, "metrics": 4, "escalation": 1}
MOST_TEXTS = 10_000


def plays_from_table(wording: DataFrame) -> tuple[Play, ...]:
    """The rules in the words of a table: action_type, signals, list, position, text.

    ``list`` is one of LISTS, ``position`` counts from 1, ``signals`` names the branch of an
    immediate step (separated by blanks; empty or null for the last branch, and in other lists). The
    play for all other action types has a null action_type. A name in braces is filled from the
    account's row; names must be those of ``SHOWN``. What the table leaves out keeps the default.
    Unknown plays, branches, places or names are errors, as is one place twice. A playbook is small:
    tables of over MOST_TEXTS rows are refused.
    """
    rows = wording.select(
        "action_type",
        F.coalesce("signals", F.lit("")).alias("signals"),
        F.col("list").alias("list_name"),
        F.col("position").cast("int"),
        "text",
    ).take(MOST_TEXTS + 1)
    if len(rows) > MOST_TEXTS:
        raise ValueError(f"a playbook table has at most {MOST_TEXTS} rows")
    texts: dict[tuple, str] = {}
    for action_type, signals, list_name, position, text in rows:
        key = (action_type, tuple(signals.split()), list_name, position)
        unknown = set(re.findall(r"\{(\w+)\}", text or "")) - SHOWN.keys()
        if list_name not in LISTS or position not in range(1, LISTS[list_name] + 1) or not text or unknown:
            raise ValueError(f"no such playbook entry: {key} {text!r}")
        if key in texts:
            raise ValueError(f"two playbook entries for {key}")
        texts[key] = text

    def own(default: tuple[str, ...], action_type: str | None, signals: tuple, name: str) -> tuple[str, ...]:
        places = enumerate(default, 1)
        return tuple(texts.pop((action_type, signals, name, place), text) for place, text in places)

    plays = []
    for play in PLAYS:
        kind = play.action_type
        branches = tuple(Branch(b.signals, own(b.steps, kind, b.signals, "immediate")) for b in play.branches)
        plays.append(
            play._replace(
                branches=branches,
                phase_2=own(play.phase_2, kind, (), "phase_2"),
                metrics=own(play.metrics, kind, (), "metrics"),
                escalation=own((play.escalation,), kind, (), "escalation")[0],
            )
        )
    if texts:
        raise ValueError(f"no such playbook branch: {sorted(map(str, texts))[:3]}")
    return tuple(plays)
