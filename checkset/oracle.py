"""DuckDB SQL for each query, stated independently of the Spark operators.

Scores are kept as whole hundredths here and averages as whole cents, so nothing is rounded twice.
Only the playbook wording is shared with the library; branch order and conditions are not.
"""

from __future__ import annotations

import re

from checkset import registry
from checkset.fixture import AS_OF, FEATURE_NAMES, INDUSTRIES
from tallyscope.operators import explain
from tallyscope.operators.actions import NEXT_ACTIONS
from tallyscope.plans.playbook_content import PLAYS
from tallyscope.sources.schemas import CONTRACTS

TODAY = f"DATE '{AS_OF}'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(index: str, values: tuple[str, ...]) -> str:
    return f"([{', '.join(map(_text, values))}])[{index} + 1]"


def _steps(column: str, op: str, edges: tuple, points: tuple) -> str:
    """Points chosen by how many of the ascending edges are passed (NULL passes none)."""
    passed = " + ".join(f"coalesce(({column} {op} {edge})::INT, 0)" for edge in edges)
    return f"([{', '.join(map(str, points))}])[1 + {passed}]"


def _day(offset: str) -> str:
    return f"({TODAY} + CAST({offset} AS INTEGER))"


def _stamp(days: str, seconds: str) -> str:
    return f"(CAST({_day(days)} AS TIMESTAMP) + to_seconds({seconds}))"


def _account(seed: str) -> str:
    u = "u"
    return (
        f"{seed} AS x, CAST(({seed}) % 1000003 AS DOUBLE) / 1000003::DOUBLE AS {u}, "
        f"CAST(floor((SELECT CAST(count(*) AS DOUBLE) FROM customer) * u * u * u) AS BIGINT) AS acc"
    )


def _hundredths(column: str) -> str:
    return f"printf('%d.%02d', {column} // 100, {column} % 100)"


def _mean(total: str, rows: str) -> str:
    """Non-negative whole ``total`` over ``rows``, rounded half up, as a value in hundredths."""
    return f"CAST((2 * ({total}) + {rows}) // (2 * nullif({rows}, 0)) AS DOUBLE) / 100"


def _usage(offset: str) -> str:
    """Usage features on the day ``offset`` days from TODAY."""
    return f"""
        SELECT account_id, count(*) AS total_usage_events,
          count(*) FILTER (event_timestamp >= {_stamp(f"{offset} - 30", "0")}) AS usage_events_last_30_days,
          count(*) FILTER (event_timestamp >= {_stamp(f"{offset} - 7", "0")}) AS usage_events_last_7_days,
          count(DISTINCT user_id) AS active_users_total,
          count(DISTINCT user_id) FILTER (event_timestamp >= {_stamp(f"{offset} - 30", "0")})
            AS active_users_last_30_days,
          count(DISTINCT feature_name) AS distinct_features_used,
          {_mean("sum(CAST(session_duration_minutes * 100 AS BIGINT))",
                 "count(session_duration_minutes)")} AS avg_session_duration_minutes,
          max(event_timestamp) AS last_product_event_at,
          {_day(offset)} - CAST(max(event_timestamp) AS DATE) AS days_since_last_product_event
        FROM product_usage_events GROUP BY account_id"""


_K = "o_orderkey"

BASE_TABLES = {
    "accounts": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS company_name,
          {_pick("c_custkey % 7", INDUSTRIES)} AS industry,
          {_pick("c_nationkey % 3", ("Startup", "Mid-Market", "Enterprise"))} AS segment,
          10 + (c_custkey * 97) % 4990 AS company_size,
          CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) * 20 AS DECIMAL(12,2))
            AS annual_recurring_revenue,
          {_pick("c_custkey % 3", ("Starter", "Professional", "Enterprise"))} AS plan_type,
          {_pick("c_custkey % 5", ("Active", "Healthy", "At Risk", "Onboarding", "Churned"))}
            AS customer_stage,
          CASE WHEN c_custkey % 31 <> 30 THEN 'Owner ' || c_custkey % 5 END AS account_owner,
          {_day("-((c_custkey * 29) % 700)")} AS contract_start_date,
          CASE WHEN c_custkey % 23 <> 22 THEN {_day("(c_custkey * 37) % 400 - 10")} END
            AS renewal_date,
          {_stamp("-((c_custkey * 29) % 700)", "0")} AS created_at,
          {_stamp("0", "0")} AS updated_at
        FROM customer""",
    "product_usage_events": f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(acc AS VARCHAR) AS account_id,
          CASE WHEN event_id % 97 <> 96 THEN 'u' || user_id % (3 + (acc * 13) % 70) END AS user_id,
          event_type, {_pick("event_id % 7", FEATURE_NAMES)} AS feature_name,
          CAST(value AS DECIMAL(10,2)) AS session_duration_minutes, ts AS event_timestamp
        FROM (SELECT *, {_account("event_id * 7919")} FROM events)
        UNION ALL
        SELECT 'w-' || l_orderkey || '-' || l_linenumber, CAST(acc AS VARCHAR),
          'u' || (x // 7) % (3 + (acc * 13) % 70), l_returnflag,
          {_pick("l_partkey % 7", FEATURE_NAMES)},
          CASE WHEN x % 89 <> 88 THEN CAST(l_quantity AS DECIMAL(10,2)) END,
          {_stamp("2 - x % 120", "x % 86400")}
        FROM (SELECT *,
          {_account("l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709")}
          FROM lineitem)""",
    "customer_engagement": f"""
        SELECT 'e' || k AS engagement_id, CASE WHEN k % 19 = 18 THEN 'x' ELSE '' END || k
            AS account_id,
          (k * 3) % 31 AS emails_opened, (k * 5) % 11 AS emails_replied,
          (k * 7) % 4 AS meetings_last_30_days, (m * m + 3 * m) % 12
            AS support_tickets_last_30_days,
          CASE WHEN k % 17 <> 16 THEN (m * m * 5 + m) % 11 END AS nps_score,
          {_day("-((k * 11) % 80)")} AS last_touch_date
        FROM (SELECT c_custkey AS k, c_custkey % 9973 AS m FROM customer)""",
    "crm_opportunities": f"""
        SELECT 'o' || {_K} AS opportunity_id, CAST(o_custkey AS VARCHAR) AS account_id,
          CASE {_K} % 16 WHEN 0 THEN 'Expansion' WHEN 1 THEN 'Team upsell'
            WHEN 2 THEN 'Cross-sell' ELSE 'Renewal' END AS opportunity_type,
          CASE WHEN {_K} % 211 = 210 THEN NULL
            WHEN {_K} % 4 <> 0 OR o_custkey % 5 = 0
              THEN CASE WHEN {_K} % 2 = 0 THEN 'Closed Won' ELSE 'Closed Lost' END
            WHEN o_orderstatus = 'O' THEN 'Proposal' WHEN o_orderstatus = 'P' THEN 'Negotiation'
            ELSE 'Prospecting' END AS pipeline_stage,
          CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.25 AS DECIMAL(12,2)) AS amount,
          10 + {_K} * 7 % 81 AS probability,
          {_day(f"-(30 + {_K} * 13 % 150)")} AS created_date,
          {_day(f"{_K} * 17 % 300 - 30")} AS expected_close_date,
          {_day(f"-(1 + {_K} * 11 % 60)")} AS last_activity_date
        FROM orders""",
    "score_history": f"""
        SELECT 's' || {_K} AS score_id, CAST(o_custkey AS VARCHAR) AS account_id,
          ({_K} * 31) % 9001 AS health_score, ({_K} * 37) % 9001 AS churn_score,
          ({_K} * 41) % 9001 AS expansion_score, 'reason ' || {_K} % 4 AS score_reason,
          CASE WHEN {_K} % 301 <> 300 THEN {_day(f"-(30 * (1 + {_K} % 12))")} END AS calculated_at
        FROM orders""",
    "actions": f"""
        SELECT 'a' || {_K} AS action_id,
          CASE WHEN {_K} % 503 = 502 THEN 'x' ELSE '' END || o_custkey AS account_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority,
          {_pick(f"{_K} % 8", ("Pending", "In Progress", "Dismissed", "Dismissed",
                               "Completed", "Completed", "Completed", "Completed"))} AS status,
          {_day(f"{_K} % 61 - 40")} AS due_date
        FROM orders""",
    "experiments": "SELECT 'x' || p_partkey AS experiment_id FROM part",
    "system_logs": "SELECT CAST(event_id AS VARCHAR) AS log_id FROM events",
}

_ACTIVE = "status IN ('Pending', 'In Progress')"
_OPEN = "pipeline_stage NOT IN ('Closed Won', 'Closed Lost')"

FEATURES = {
    "f_action": f"""
        SELECT account_id, count(*) AS total_action_count,
          count(*) FILTER ({_ACTIVE}) AS active_action_count,
          count(*) FILTER (status = 'Pending') AS pending_action_count,
          count(*) FILTER (status = 'In Progress') AS in_progress_action_count,
          count(*) FILTER (status = 'Completed') AS completed_action_count,
          count(*) FILTER (status = 'Dismissed') AS dismissed_action_count,
          count(*) FILTER (priority IN ('Critical', 'High')) AS high_priority_action_count,
          count(*) FILTER (priority = 'Critical') AS critical_action_count,
          count(*) FILTER ({_ACTIVE} AND due_date < {TODAY}) AS overdue_action_count,
          min(due_date) FILTER ({_ACTIVE}) AS next_open_action_due_date
        FROM actions GROUP BY account_id""",
    "f_engagement": f"""
        SELECT account_id, emails_opened, emails_replied, meetings_last_30_days,
          support_tickets_last_30_days, nps_score, last_touch_date,
          {TODAY} - last_touch_date AS days_since_last_touch,
          CASE WHEN emails_opened > 0
            THEN CAST((emails_replied * 20000 + emails_opened) // (2 * emails_opened) AS DOUBLE)
              / 100 ELSE 0 END AS email_reply_rate_percent,
          {_steps("meetings_last_30_days", ">=", (1, 2), ("'low'", "'medium'", "'high'"))}
            AS meeting_engagement_level,
          {_steps("support_tickets_last_30_days", ">=", (4, 8), ("'low'", "'medium'", "'high'"))}
            AS support_pressure_level,
          {_steps("nps_score", ">=", (5, 8), ("'detractor'", "'neutral'", "'promoter'"))}
            AS nps_category
        FROM customer_engagement""",
    "f_opportunity": f"""
        SELECT account_id, count(*) AS total_opportunity_count,
          count(*) FILTER ({_OPEN}) AS open_opportunity_count,
          coalesce(sum(amount) FILTER ({_OPEN}), 0) AS open_pipeline_value,
          coalesce(sum(CAST(amount * 100 AS BIGINT) * probability) FILTER ({_OPEN}), 0)
            AS weighted_pipeline_units,
          min(expected_close_date) FILTER ({_OPEN}) AS next_expected_close_date,
          {TODAY} - max(last_activity_date) AS days_since_last_crm_activity,
          count(*) FILTER (opportunity_type ILIKE '%expansion%' OR opportunity_type ILIKE '%upsell%')
            AS expansion_opportunity_count
        FROM crm_opportunities GROUP BY account_id""",
    "f_score": """
        SELECT * FROM score_history h WHERE score_id = (
          SELECT score_id FROM score_history i WHERE i.account_id = h.account_id
          ORDER BY calculated_at IS NULL DESC, calculated_at DESC, score_id LIMIT 1)""",
    "f_usage": _usage("0"),
}


def _zero(*columns: str) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)


FEATURES["feats"] = f"""
    SELECT a.*, renewal_date - {TODAY} AS days_until_renewal,
      {_zero("total_usage_events", "usage_events_last_30_days", "usage_events_last_7_days",
             "active_users_total", "active_users_last_30_days", "distinct_features_used",
             "avg_session_duration_minutes")},
      last_product_event_at, days_since_last_product_event,
      {_zero("emails_opened", "emails_replied", "meetings_last_30_days",
             "support_tickets_last_30_days")},
      nps_score, last_touch_date, days_since_last_touch, {_zero("email_reply_rate_percent")},
      meeting_engagement_level, support_pressure_level, nps_category,
      {_zero("total_opportunity_count", "open_opportunity_count", "open_pipeline_value",
             "weighted_pipeline_units")},
      next_expected_close_date, next_expected_close_date - {TODAY}
        AS days_until_next_expected_close, days_since_last_crm_activity,
      {_zero("expansion_opportunity_count")},
      health_score, churn_score, expansion_score, score_reason, calculated_at,
      {_zero("total_action_count", "active_action_count", "pending_action_count",
             "in_progress_action_count", "completed_action_count", "dismissed_action_count",
             "high_priority_action_count", "critical_action_count", "overdue_action_count")},
      next_open_action_due_date
    FROM accounts a LEFT JOIN f_usage USING (account_id) LEFT JOIN f_engagement USING (account_id)
      LEFT JOIN f_opportunity USING (account_id) LEFT JOIN f_score USING (account_id)
      LEFT JOIN f_action USING (account_id)"""

# h, c, r, e: health, churn risk, raw and damped expansion in hundredths.
SCORING = {
    "parts": f"""
        SELECT *,
          {_steps("usage_events_last_30_days", ">=", (25, 50, 80, 120), (20, 45, 70, 85, 100))}
            AS usage_activity_score,
          {_steps("active_users_last_30_days", ">=", (10, 20, 35, 60), (20, 45, 70, 85, 100))}
            AS active_user_score,
          {_steps("nps_score", ">=", (3, 5, 7, 9), (10, 30, 55, 80, 100))} AS nps_score_component,
          {_steps("days_since_last_touch", "<=", (60, 30, 14, 7), (10, 35, 60, 80, 100))}
            AS engagement_recency_score,
          {_steps("support_tickets_last_30_days", "<=", (7, 4, 2, 0), (10, 35, 65, 85, 100))}
            AS support_health_score,
          {_steps("overdue_action_count", "<=", (4, 2, 1, 0), (5, 25, 50, 75, 100))}
            AS action_discipline_score,
          {_steps("days_until_renewal", "<=", (180, 90, 60, 30), (15, 35, 60, 80, 100))}
            AS renewal_risk_score,
          ([10, 40, 60, 80, 100])[1 + (open_pipeline_value > 0)::INT
            + (open_pipeline_value >= 50000)::INT + (open_pipeline_value >= 100000)::INT
            + (open_pipeline_value >= 250000)::INT] AS pipeline_value_score,
          ([10, 55, 80, 100])[1 + least(expansion_opportunity_count, 3)] AS expansion_signal_score
        FROM feats""",
    "points": """
        SELECT *,
          25 * usage_activity_score + 20 * active_user_score + 20 * nps_score_component
            + 15 * engagement_recency_score + 10 * support_health_score
            + 10 * action_discipline_score AS h,
          8500 - 20 * usage_activity_score - 15 * active_user_score - 20 * nps_score_component
            - 15 * support_health_score - 15 * action_discipline_score
            + 15 * renewal_risk_score AS c,
          25 * usage_activity_score + 20 * active_user_score + 20 * nps_score_component
            + 20 * pipeline_value_score + 15 * expansion_signal_score AS r
        FROM parts""",
    "scored": f"""
        SELECT *, {_hundredths("h")} AS h_text, {_hundredths("c")} AS c_text,
          {_hundredths("e")} AS e_text, days_until_renewal AS d,
          {_steps("c", ">=", (4000, 6000, 7500),
                  ("'Low Risk'", "'Moderate Risk'", "'High Risk'", "'Critical Risk'"))} AS risk_1,
          {_steps("c", ">=", (4000, 5000, 6000),
                  ("'Low Risk'", "'Moderate Risk'", "'High Risk'", "'Critical Risk'"))} AS risk_2,
          {_steps("e", ">=", (5000, 7500),
                  ("'Low Expansion'", "'Medium Expansion'", "'High Expansion'"))} AS growth
        FROM (SELECT *, CASE WHEN c >= 7000 THEN (r * 65 + 50) // 100
          WHEN c >= 5500 THEN (r * 85 + 50) // 100 ELSE r END AS e FROM points)""",
    "tiered": """
        SELECT *,
          CASE WHEN c >= 7500 THEN CASE WHEN d <= 90 THEN 'Tier 1 - Save Immediately'
              ELSE 'Tier 1 - Churn Intervention' END
            WHEN c >= 6000 AND d <= 120 THEN 'Tier 2 - Renewal Risk Watch'
            WHEN e >= 7500 AND c < 5000 THEN 'Tier 2 - Expansion Ready'
            WHEN e >= 6000 AND c < 6000 THEN 'Tier 3 - Expansion Nurture'
            WHEN h >= 6500 AND c < 4000 THEN 'Tier 3 - Maintain' ELSE 'Tier 4 - Monitor'
          END AS tier_1,
          CASE WHEN c >= 6000 THEN CASE WHEN d <= 90 THEN 'Tier 1 - Save Immediately'
              ELSE 'Tier 1 - Churn Intervention' END
            WHEN c >= 5000 THEN CASE WHEN d <= 120 THEN 'Tier 2 - Renewal Risk Watch'
              ELSE 'Tier 2 - Churn Risk Watch' END
            WHEN e >= 7500 AND c < 4500 THEN 'Tier 2 - Expansion Ready'
            WHEN e >= 6000 THEN 'Tier 3 - Expansion Nurture'
            WHEN h >= 6500 AND c < 4000 THEN 'Tier 3 - Maintain' ELSE 'Tier 4 - Monitor'
          END AS tier_2,
          CASE WHEN c >= 6000 THEN CASE WHEN d <= 90 THEN 'Tier 1 - Save Immediately'
              ELSE 'Tier 1 - Churn Intervention' END
            WHEN c >= 5000 THEN CASE WHEN d <= 120 THEN 'Tier 2 - Renewal Risk Watch'
              ELSE 'Tier 2 - Churn Risk Watch' END
            WHEN c >= 4000 AND d <= 30 THEN 'Tier 2 - Renewal Review'
            WHEN c >= 4000 AND d <= 60 THEN 'Tier 3 - Renewal Monitor'
            WHEN e >= 7500 THEN CASE WHEN d <= 60 THEN 'Tier 2 - Renewal Expansion Review'
              ELSE 'Tier 2 - Expansion Ready' END
            WHEN e >= 6000 THEN 'Tier 3 - Expansion Nurture'
            WHEN h >= 6500 AND c < 4000 THEN 'Tier 3 - Maintain' ELSE 'Tier 4 - Monitor'
          END AS tier
        FROM scored""",
}

_NEXT = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in NEXT_ACTIONS.items())
_BY_TIER = "substr(tier, 10)"

ACTIONS = {
    "recommended": f"""
        SELECT *,
          CASE {_BY_TIER} WHEN 'Save Immediately' THEN 'Executive Renewal Save Plan'
            WHEN 'Churn Intervention' THEN 'Immediate Churn Intervention'
            WHEN 'Renewal Risk Watch' THEN 'Renewal Risk Review'
            WHEN 'Churn Risk Watch' THEN 'CSM Risk Review'
            WHEN 'Renewal Review' THEN 'Renewal Readiness Review'
            WHEN 'Renewal Expansion Review' THEN 'Renewal and Expansion Review'
            WHEN 'Expansion Ready' THEN 'Expansion Discovery'
            WHEN 'Renewal Monitor' THEN 'Renewal Monitoring'
            WHEN 'Expansion Nurture' THEN 'Expansion Nurture'
            WHEN 'Maintain' THEN 'Maintain Account Health' ELSE 'Monitor Account' END AS act,
          ([
            'Critical', 'High', 'Medium', 'Low'])[CAST(substr(tier, 6, 1) AS INT)] AS priority,
          CASE tier {_NEXT} END AS next_action,
          CASE WHEN {_BY_TIER} IN ('Expansion Ready', 'Renewal Expansion Review')
            THEN 'Account Executive' ELSE (['Customer Success Leadership',
              'Customer Success Manager', 'Account Owner', 'Revenue Operations'])[
              CAST(substr(tier, 6, 1) AS INT)] END AS role,
          {TODAY} + CASE {_BY_TIER} WHEN 'Save Immediately' THEN 1 WHEN 'Churn Intervention' THEN 2
            ELSE ([0, 5, 14, 30])[CAST(substr(tier, 6, 1) AS INT)] END AS due,
          CASE substr(tier, 6, 1)
            WHEN '1' THEN concat('High churn risk score of ', c_text, ', health score of ', h_text,
              ', ', d, ' days until renewal, ', usage_events_last_30_days,
              ' usage events in the last 30 days, ', support_tickets_last_30_days,
              ' support tickets, and ', overdue_action_count, ' overdue actions.')
            WHEN '2' THEN concat('Priority driven by ', risk_2, ', ', growth, ', ', d,
              ' days until renewal, churn risk score of ', c_text,
              ', and expansion score of ', e_text, '.')
            WHEN '3' THEN concat('Account has manageable risk with health score of ', h_text,
              ', churn risk score of ', c_text, ', and expansion score of ', e_text, '.')
            ELSE concat('Account currently has low urgency with health score of ', h_text,
              ', churn risk score of ', c_text, ', and expansion score of ', e_text, '.')
          END AS reason
        FROM tiered""",
}

_FILL = {
    "tickets": "CAST(support_tickets_last_30_days AS VARCHAR)",
    "usage": "CAST(usage_events_last_30_days AS VARCHAR)",
    "users": "CAST(active_users_last_30_days AS VARCHAR)",
    "overdue": "CAST(overdue_action_count AS VARCHAR)",
    "nps": "CAST(nps_score AS VARCHAR)",
    "days": "CAST(d AS VARCHAR)",
    "health": "h_text",
    "churn": "c_text",
    "exp": "e_text",
    "owner": "account_owner",
    "role": "role",
    "due": "coalesce(CAST(due AS VARCHAR), 'TBD')",
}


def _template(template: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(
        _FILL[p] if i % 2 else _text(p) for i, p in enumerate(pieces) if p
    )


def _by_branch(texts) -> str:
    arms, number = [], 0
    for play in PLAYS:
        for branch in play.branches:
            number += 1
            listed = texts(play, branch)
            value = (
                f"[{', '.join(map(_template, listed))}]"
                if isinstance(listed, tuple)
                else _template(listed)
            )
            arms.append(f"WHEN {number} THEN {value}")
    return "CASE branch " + " ".join(arms) + " END"


ACTIONS["branched"] = """
    SELECT *,
      support_tickets_last_30_days >= 5 AS high_support,
      support_tickets_last_30_days BETWEEN 3 AND 4 AS moderate_support,
      usage_events_last_30_days <= 15 AS low_usage, usage_events_last_30_days >= 50 AS high_usage,
      active_users_last_30_days <= 5 AS very_low_users,
      nps_score <= 5 AS low_nps, nps_score >= 8 AS high_nps,
      d <= 30 AS renewal_imminent, d <= 90 AS renewal_near,
      c >= 6000 AS very_high_churn, h >= 6500 AS healthy, e >= 6500 AS strong_expansion,
      overdue_action_count >= 2 AS has_overdue,
      CASE act
        WHEN 'Immediate Churn Intervention' THEN CASE WHEN high_support AND low_usage THEN 1
          WHEN high_support THEN 2 WHEN low_usage THEN 3 ELSE 4 END
        WHEN 'Executive Renewal Save Plan' THEN CASE WHEN renewal_imminent THEN 5
          WHEN renewal_near THEN 6 ELSE 7 END
        WHEN 'CSM Risk Review' THEN CASE WHEN high_support AND low_nps THEN 8 WHEN low_nps THEN 9
          WHEN high_support THEN 10 ELSE 11 END
        WHEN 'Renewal Readiness Review' THEN CASE WHEN renewal_imminent THEN 12
          WHEN renewal_near THEN 13 ELSE 14 END
        WHEN 'Renewal Risk Review' THEN CASE WHEN renewal_imminent AND very_high_churn THEN 15
          WHEN renewal_imminent THEN 16 ELSE 17 END
        WHEN 'Renewal and Expansion Review' THEN
          CASE WHEN renewal_imminent AND strong_expansion THEN 18 ELSE 19 END
        WHEN 'Expansion Discovery' THEN CASE WHEN strong_expansion AND high_usage THEN 20
          ELSE 21 END
        WHEN 'Expansion Nurture' THEN CASE WHEN high_usage AND strong_expansion THEN 22
          WHEN strong_expansion THEN 23 ELSE 24 END
        WHEN 'Maintain Account Health' THEN CASE WHEN has_overdue THEN 25
          WHEN high_usage AND healthy THEN 26 ELSE 27 END
        WHEN 'Monitor Account' THEN CASE WHEN has_overdue AND high_support THEN 28
          WHEN has_overdue THEN 29 ELSE 30 END
        WHEN 'Renewal Monitoring' THEN CASE WHEN renewal_imminent THEN 31 ELSE 32 END
        ELSE 33 END AS branch
    FROM recommended"""
ACTIONS["played"] = f"""
    SELECT *, {_by_branch(lambda play, branch: branch.steps)} AS steps,
      {_by_branch(lambda play, branch: play.phase_2)} AS later,
      {_by_branch(lambda play, branch: play.metrics)} AS metrics,
      {_by_branch(lambda play, branch: play.escalation)} AS escalation,
      CASE act
        WHEN 'Immediate Churn Intervention' THEN CASE WHEN c >= 6000 AND d <= 90
          THEN 'CRITICAL — within 24 hours' ELSE 'Immediate — within 48 hours' END
        WHEN 'Executive Renewal Save Plan' THEN CASE WHEN d <= 30 THEN 'URGENT — within 24 hours'
          WHEN d <= 90 THEN 'Urgent — within 1 week' ELSE 'High priority — within 2 weeks' END
        WHEN 'CSM Risk Review' THEN CASE WHEN low_nps AND high_support
          THEN 'Urgent — within 1 week' ELSE 'Within 1–2 weeks' END
        WHEN 'Renewal Readiness Review' THEN CASE WHEN d <= 30 THEN 'URGENT — this week'
          WHEN d <= 90 THEN 'Within 2 weeks' ELSE 'Within 30 days' END
        WHEN 'Renewal Risk Review' THEN CASE WHEN d <= 30 AND c >= 6000
          THEN 'CRITICAL — within 24 hours' WHEN d <= 30 THEN 'Immediate — within 48 hours'
          ELSE 'Within 1 week' END
        WHEN 'Renewal and Expansion Review' THEN CASE WHEN d <= 30 THEN 'URGENT — this week'
          WHEN d <= 90 THEN 'Within 2 weeks' ELSE 'This quarter' END
        WHEN 'Expansion Discovery' THEN 'Within 30 days'
        WHEN 'Expansion Nurture' THEN '30–60 day nurture cycle'
        WHEN 'Maintain Account Health' THEN 'Ongoing — quarterly cadence'
        WHEN 'Monitor Account' THEN '30-day monitoring cycle'
        WHEN 'Renewal Monitoring' THEN CASE WHEN d <= 30 THEN 'Within 48 hours of renewal date'
          ELSE 'Monthly checkpoint' END
        ELSE 'Review within 2 weeks' END AS timeline
    FROM branched"""
ACTIONS["intel"] = f"""
    SELECT *,
      {_steps("h", ">=", (4000, 6000, 8000), ("'Unhealthy'", "'Weak'", "'Stable'", "'Healthy'"))}
        AS health_status,
      {_steps("c", ">=", (4000, 5000, 6000),
              ("'Normal'", "'Watch'", "'Elevated Risk'", "'Immediate Risk'"))} AS churn_status,
      {_steps("e", ">=", (5000, 7500),
              ("'No Clear Expansion Signal'", "'Expansion Possible'", "'Expansion Ready'"))}
        AS expansion_status,
      CASE WHEN tier LIKE 'Tier 1%' THEN 'Save' WHEN tier LIKE '%Churn%' THEN 'Recover'
        WHEN tier LIKE '%Renewal%' THEN 'Renewal' WHEN tier LIKE '%Expansion%' THEN 'Expand'
        WHEN tier LIKE '%Maintain%' THEN 'Maintain' ELSE 'Monitor' END AS motion,
      list_position(['Critical', 'High', 'Medium', 'Low'], priority) AS prio_rank,
      CASE WHEN priority = 'Critical' THEN 'Critical recommended action requires leadership review.'
        WHEN c >= 6000 THEN 'Account has critical churn risk.'
        WHEN c >= 5000 THEN 'Account has high churn risk.'
        WHEN d <= 30 AND c >= 4000
          THEN 'Account is within 30 days of renewal and has meaningful churn risk.'
        WHEN d <= 30 THEN 'Account is within 30 days of renewal.'
        WHEN d <= 60 AND c >= 4000
          THEN 'Account is within 60 days of renewal and has meaningful churn risk.'
        WHEN overdue_action_count >= 3
          THEN concat('Account has ', overdue_action_count, ' overdue actions.')
        END AS review,
      review IS NOT NULL AS flagged,
      coalesce(review, 'No manual review required based on current rules.') AS review_text,
      concat(company_name, ' is a ', segment, ' ', industry, ' account on the ', plan_type,
        ' plan. Health score is ', h_text, ', churn risk score is ', c_text,
        ', expansion score is ', e_text, '. The account is categorized as ', risk_2, ' with ',
        growth, '. Recommended action: ', act, '. Reason: ', reason) AS context
    FROM played"""

CTES = {**BASE_TABLES, **FEATURES, **SCORING, **ACTIONS}


def _with(select: str) -> str:
    """Prefix the CTEs a statement needs, in dependency order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\b[a-z]\w*\b", re.sub(r"'(?:[^']|'')*'", "", sql))):
            if word in CTES and word not in needed and re.search(rf"(FROM|JOIN)\s+{word}\b", sql):
                needed.add(word)
                visit(CTES[word])

    visit(select)
    if not needed:
        return select
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {parts}\n{select}"


def _score(column: str, name: str) -> str:
    return f"CAST({column} AS DOUBLE) / 100 AS {name}"


def _double(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS DOUBLE) AS {name or column}"


def _date(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS VARCHAR) AS {name or column}"


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def _big(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS BIGINT) AS {name or column}"


def _list(column: str, name: str) -> str:
    entries = f"list_transform({column}, lambda x: coalesce(x, '{registry.NULL_ENTRY}'))"
    return f"array_to_string({entries}, '{registry.LIST_SEPARATOR}') AS {name}"


_PROFILE = f"""account_id, company_name, industry, segment, {_big("company_size")},
    {_double("annual_recurring_revenue")}, plan_type, customer_stage, account_owner"""
_SCORES = f"""{_score("h", "computed_health_score")}, {_score("c", "computed_churn_risk_score")},
    {_score("e", "computed_expansion_score")}"""
_USAGE = ", ".join(
    _big(c)
    for c in (
        "usage_events_last_30_days",
        "active_users_last_30_days",
        "support_tickets_last_30_days",
        "nps_score",
        "overdue_action_count",
    )
)
_PLAYBOOK = f"""{_list("steps", "immediate_next_steps")}, {_list("later", "phase_2_next_steps")},
    {_list("metrics", "success_metrics")}, escalation AS escalation_guidance,
    timeline AS timeline_label, 'action_playbook_v1' AS playbook_version"""
_COMPONENTS = ", ".join(
    _big(c)
    for c in (
        "usage_activity_score",
        "active_user_score",
        "nps_score_component",
        "engagement_recency_score",
        "support_health_score",
        "action_discipline_score",
        "renewal_risk_score",
        "pipeline_value_score",
        "expansion_signal_score",
    )
)
_LATEST = f"""{_score("health_score", "latest_health_score")},
    {_score("churn_score", "latest_churn_score")},
    {_score("expansion_score", "latest_expansion_score")},
    score_reason AS latest_score_reason, {_date("calculated_at", "latest_score_date")}"""
_INTELLIGENCE = f"""{_PROFILE}, {_date("renewal_date")}, {_big("d", "days_until_renewal")}, {_USAGE},
    {_double("open_pipeline_value")}, {_SCORES}, risk_2 AS risk_level, growth AS expansion_level,
    tier AS customer_priority_tier, act AS recommended_action_type,
    priority AS recommended_action_priority, next_action AS recommended_next_action,
    role AS suggested_owner_role, {_date("due", "recommended_due_date")},
    reason AS recommendation_reason, health_status, churn_status, expansion_status,
    motion AS primary_business_motion, {_big("prio_rank", "dashboard_priority_rank")},
    flagged AS needs_human_review, review_text AS human_review_reason,
    context AS ai_explanation_context,
    'phase_14_v3_dashboard_ready_account_intelligence_with_review_reason'
      AS intelligence_view_version, company_name AS account_name, {_PLAYBOOK}"""
_AVERAGES = f"""{_mean("sum(h)", "count(*)")} AS avg_health_score,
    {_mean("sum(c)", "count(*)")} AS avg_churn_risk_score,
    {_mean("sum(e)", "count(*)")} AS avg_expansion_score"""
_ARR = "CAST(sum(annual_recurring_revenue) AS DOUBLE)"
_PIPELINE = "CAST(sum(open_pipeline_value) AS DOUBLE)"
_ORDER = "prio_rank, c DESC, d ASC NULLS LAST, account_id"
_URGENCY = """(CASE priority WHEN 'Critical' THEN 1000 WHEN 'High' THEN 500 ELSE 0 END
    + CASE risk_2 WHEN 'Critical Risk' THEN 200 WHEN 'High Risk' THEN 100 ELSE 0 END
    + CASE WHEN flagged THEN 50 ELSE 0 END) * 100 + c"""
_RISKY = "c >= 5000"
_GROWING = "(motion = 'Expand' OR e >= 6000)"


def _found(term: str) -> str:
    fields = (
        "company_name", "industry", "segment", "plan_type", "account_owner", "motion", "risk_2",
        "growth", "act", "next_action", "role", "reason",
    )
    wanted = _text(term.strip().lower())
    return "(" + " OR ".join(
        f"coalesce(contains(lower({f}), {wanted}), false)" for f in fields
    ) + ")"


def _numbered(columns: str, source: str, order: str, limit: int) -> str:
    return f"""SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position
        FROM {source} QUALIFY position <= {limit}"""


def _motion_count(motion: str) -> str:
    return f"count(*) FILTER (motion = '{motion}') AS {motion.lower()}_motion_accounts"


KPIS = f"""SELECT count(*) AS total_accounts,
    count(*) FILTER (risk_2 = 'Critical Risk') AS critical_risk_accounts,
    count(*) FILTER (risk_2 = 'High Risk') AS high_risk_accounts,
    count(*) FILTER (growth = 'High Expansion') AS high_expansion_accounts,
    count(*) FILTER (flagged) AS accounts_needing_human_review,
    {", ".join(map(_motion_count, ("Save", "Recover", "Renewal", "Expand")))},
    {_AVERAGES}, {_ARR} AS total_arr,
    CAST(sum(annual_recurring_revenue) FILTER ({_RISKY}) AS DOUBLE) AS arr_at_risk,
    {_PIPELINE} AS total_open_pipeline,
    CAST(sum(open_pipeline_value) FILTER (e >= 7500) AS DOUBLE) AS high_expansion_pipeline,
    'phase_15_v1_dashboard_kpis' AS dashboard_kpi_version
    FROM intel"""
RISKS = f"""SELECT risk_2 AS risk_level, count(*) AS account_count, {_AVERAGES},
    {_ARR} AS total_arr, {_PIPELINE} AS total_open_pipeline,
    count(*) FILTER (flagged) AS accounts_needing_human_review,
    'phase_15_v1_dashboard_risk_summary' AS dashboard_risk_summary_version
    FROM intel GROUP BY risk_2"""
OWNERS = f"""SELECT role AS suggested_owner_role, count(*) AS assigned_account_count,
    count(*) FILTER (priority = 'Critical') AS critical_action_count,
    count(*) FILTER (priority = 'High') AS high_action_count,
    count(*) FILTER (priority = 'Medium') AS medium_action_count,
    count(*) FILTER (priority = 'Low') AS low_action_count,
    count(*) FILTER (flagged) AS human_review_count, {_AVERAGES},
    {_ARR} AS total_arr_owned, {_PIPELINE} AS total_pipeline_owned,
    'phase_15_v1_dashboard_owner_workload' AS dashboard_owner_workload_version
    FROM intel GROUP BY role"""

_KEYS = {
    "accounts": "account_id",
    "product_usage_events": "event_id",
    "customer_engagement": "engagement_id",
    "crm_opportunities": "opportunity_id",
    "score_history": "score_id",
    "actions": "action_id",
    "experiments": "experiment_id",
    "system_logs": "log_id",
}
_CHILDREN = (
    "product_usage_events",
    "customer_engagement",
    "crm_opportunities",
    "score_history",
    "actions",
)
_CRITICAL = {
    "accounts": ("account_id", "company_name", "annual_recurring_revenue", "renewal_date"),
    "customer_engagement": ("account_id", "nps_score", "support_tickets_last_30_days"),
    "score_history": ("account_id", "health_score", "churn_score", "expansion_score", "calculated_at"),
    "actions": ("account_id", "priority", "status"),
}
PRIMARY = " UNION ALL ".join(
    f"""SELECT 'primary_key' AS "check", '{t}' AS table_name, bad AS null_keys,
      extra AS duplicate_keys, CASE WHEN bad + extra = 0 THEN 'PASS' ELSE 'FAIL' END AS status
      FROM (SELECT coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS bad,
        coalesce(sum(n - 1), 0)::BIGINT AS extra
        FROM (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY 1))"""
    for t, k in _KEYS.items()
)
FOREIGN = " UNION ALL ".join(
    f"""SELECT 'foreign_key' AS "check", '{t}' AS table_name, n AS orphan_ids, no_id AS null_ids,
      CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status
      FROM (SELECT count(DISTINCT account_id) FILTER (account_id NOT IN (SELECT account_id FROM accounts)) AS n,
        count(*) FILTER (account_id IS NULL) AS no_id FROM {t})"""
    for t in _CHILDREN
)
NOT_NULL = " UNION ALL ".join(
    f"""SELECT 'not_null' AS "check", '{t}' AS table_name, '{c}' AS column_name,
      count(*) FILTER ({c} IS NULL) AS null_count,
      CASE WHEN count(*) FILTER ({c} IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {t}"""
    for t, contract in CONTRACTS.items()
    for c in contract.required
)
COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}"
    for name, source in (
        *((t, t) for t in _KEYS),
        ("recommended_actions_engine", "recommended"),
        ("account_action_playbook", "played"),
        ("account_intelligence_view", "intel"),
    )
)
NULLS = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
      count(*) FILTER ({c} IS NULL) AS null_count FROM {t}"""
    for t, columns in _CRITICAL.items()
    for c in columns
)
_COUNT_STATUS = " UNION ALL ".join(
    f"SELECT CASE WHEN count(*) = {n} THEN 'PASS' ELSE 'WARN' END AS status FROM {t}"
    for t, n in registry.EXPECTED_ROWS.items()
)
SUMMARY = f"""SELECT count(*) FILTER (status = 'PASS') AS passed,
    count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed,
    CASE WHEN failed > 0 THEN 'rejected' ELSE 'accepted' END AS verdict
    FROM (SELECT 'PASS' AS status FROM range({len(_KEYS)}) UNION ALL {_COUNT_STATUS}
      UNION ALL SELECT status FROM ({PRIMARY}) UNION ALL SELECT status FROM ({FOREIGN})
      UNION ALL SELECT status FROM ({NOT_NULL}))"""


def _display(column: str, name: str, bands: tuple) -> str:
    edges = tuple(edge for edge, _, _ in bands[1:])
    labels = tuple(_text(label) for _, label, _ in bands)
    tones = tuple(_text(tone) for _, _, tone in bands)
    return (
        f"{_steps(column, '>=', edges, labels)} AS {name}_label, "
        f"{_steps(column, '>=', edges, tones)} AS {name}_tone"
    )


_DISPLAYS = ", ".join(
    (
        _display(
            "h",
            "health",
            (
                (None, "Unhealthy", "critical"),
                (4500, "Needs attention", "warning"),
                (5500, "Moderate", "warning"),
                (7000, "Stable", "success"),
                (7500, "Healthy", "success"),
            ),
        ),
        _display(
            "c",
            "churn",
            (
                (None, "Low", "success"),
                (2500, "Moderate", "warning"),
                (4000, "High", "warning"),
                (5500, "Critical", "critical"),
            ),
        ),
        _display(
            "e",
            "expansion",
            (
                (None, "Low fit", "neutral"),
                (4000, "Emerging fit", "neutral"),
                (4500, "Moderate fit", "warning"),
                (7000, "Strong fit", "success"),
            ),
        ),
    )
)

_DOC_VALUES = {
    "days_until_renewal": "CAST(d AS VARCHAR)",
    "computed_health_score": "h_text",
    "computed_churn_risk_score": "c_text",
    "computed_expansion_score": "e_text",
    "risk_level": "risk_2",
    "expansion_level": "growth",
    "customer_priority_tier": "tier",
    "primary_business_motion": "motion",
    "recommended_action_type": "act",
    "recommended_action_priority": "priority",
    "suggested_owner_role": "role",
    "recommended_due_date": "CAST(due AS VARCHAR)",
    "timeline_label": "timeline",
    "recommendation_reason": "reason",
}


def _document() -> str:
    def shown(column: str) -> str:
        value = _DOC_VALUES.get(column, f"CAST({column} AS VARCHAR)")
        return f"coalesce(nullif({value}, ''), '—')"

    parts = [_text(explain.TITLE)]
    for heading, width, fields in explain.FIELD_BLOCKS:
        parts.append(_text(f"\n\n{heading}"))
        for name, column, bracketed in fields:
            parts += [_text(f"\n  {name:<{width}}"), shown(column)]
            if bracketed:
                parts += ["'  ('", shown(bracketed), "')'"]
    parts += [_text("\n" + explain.REVIEW_FLAG), "CASE WHEN flagged THEN 'Yes' ELSE 'No' END"]
    parts += [_text("\n" + explain.REVIEW_REASON), "review_text"]
    parts += [_text("\n\n" + explain.TEXT_BLOCKS["recommended_next_action"] + "\n  "), "next_action"]
    for column, heading in explain.LIST_BLOCKS.items():
        source = {"immediate_next_steps": "steps", "phase_2_next_steps": "later"}.get(
            column, "metrics"
        )
        parts += [
            _text(f"\n\n{heading}\n"),
            f"array_to_string(list_transform({source}, "
            "lambda t, i: concat('  ', i, '. ', coalesce(t, 'None'))), chr(10))",
        ]
    # A text with an unknown number is NULL as a whole: then its block is left out.
    parts.append(
        f"coalesce({_text(chr(10) * 2 + explain.TEXT_BLOCKS['escalation_guidance'] + chr(10) + '  ')}"
        " || escalation, '')"
    )
    return " || ".join(f"({p})" for p in parts)


_GOOD = "nps_score IS NOT NULL AND d IS NOT NULL"
PARSED = f"""SELECT account_id,
    CASE WHEN nps_score IS NULL THEN 'not JSON' WHEN d IS NULL THEN 'not an object' END
      AS parse_error,
    CASE WHEN {_GOOD} THEN context END AS ai_summary,
    CASE WHEN {_GOOD} THEN health_status END AS account_status_explanation,
    CASE WHEN {_GOOD} THEN next_action END AS recommended_next_step,
    CASE WHEN {_GOOD} THEN '' END AS why_this_action_matters,
    CASE WHEN {_GOOD} THEN timeline END AS confidence_note,
    CASE WHEN {_GOOD} THEN 'Usage=' || usage_events_last_30_days || '=' || churn_status
      || ' | NPS=' || nps_score || '= | Review=' || CASE WHEN flagged THEN 'True' ELSE 'False' END
      || '=' || risk_2 END AS key_signal_drivers,
    CASE WHEN {_GOOD} THEN {_text(explain.GUARDRAIL_NOTE)} END AS guardrail_note
    FROM intel"""

_URGENT_VALUE = f"CAST({_URGENCY} AS DOUBLE) / 100 AS urgency_score"
_SCORED_IDS = f"account_id, {_COMPONENTS}"
_V1 = f"""{_PROFILE}, {_date("renewal_date")}, {_big("d", "days_until_renewal")},
    {_USAGE}, {_big("days_since_last_touch")}, {_double("open_pipeline_value")},
    {_big("expansion_opportunity_count")}, {_LATEST}, {_COMPONENTS},
    {_score("r", "raw_expansion_score")}, {_SCORES}, risk_1 AS risk_level,
    growth AS expansion_level, tier_1 AS customer_priority_tier,
    'phase_12_v1_fixed_reference_2024_02_05' AS scoring_model_version"""
_V2 = """risk_2 AS risk_level_v2, growth AS expansion_level_v2,
    tier_2 AS customer_priority_tier_v2,
    'phase_12_v2_adjusted_classification_thresholds' AS scoring_model_version_v2"""

SELECTS = {
    "action_features": f"""SELECT * EXCLUDE (next_open_action_due_date),
        {_date("next_open_action_due_date")} FROM f_action""",
    "engagement_features": f"""SELECT * REPLACE ({_date("last_touch_date")},
        {_double("email_reply_rate_percent")}) FROM f_engagement""",
    "opportunity_features": f"""SELECT * EXCLUDE (weighted_pipeline_units) REPLACE (
        {_double("open_pipeline_value")}, {_date("next_expected_close_date")}),
        CAST(weighted_pipeline_units AS DOUBLE) / 10000 AS weighted_pipeline_value
        FROM f_opportunity""",
    "latest_score": f"SELECT score_id, account_id, {_LATEST} FROM f_score",
    "usage_features": f"SELECT * REPLACE ({_time('last_product_event_at')}) FROM f_usage",
    "usage_from_days": f"SELECT * REPLACE ({_time('last_product_event_at')}) FROM f_usage",
    "usage_over_dates": " UNION ALL ".join(
        f"""SELECT CAST({_day(str(-days))} AS VARCHAR) AS as_of, * REPLACE ({_time('last_product_event_at')})
        FROM ({_usage(str(-days))})"""
        for days in registry.DAYS_BACK
    ),
    "account_features": f"""SELECT * EXCLUDE (weighted_pipeline_units, health_score, churn_score,
        expansion_score, score_reason, calculated_at) REPLACE (
        {_double("annual_recurring_revenue")}, {_date("contract_start_date")},
        {_date("renewal_date")}, {_time("created_at")}, {_time("updated_at")},
        {_time("last_product_event_at")}, {_date("last_touch_date")},
        {_double("avg_session_duration_minutes")}, {_double("email_reply_rate_percent")},
        {_double("open_pipeline_value")}, {_date("next_expected_close_date")},
        {_date("next_open_action_due_date")}),
        CAST(weighted_pipeline_units AS DOUBLE) / 10000 AS weighted_pipeline_value, {_LATEST}
        FROM feats""",
    "component_scores": f"SELECT {_SCORED_IDS} FROM parts",
    "composite_scores": f"""SELECT account_id, {_score("r", "raw_expansion_score")}, {_SCORES}
        FROM scored""",
    "scoring_v1": f"SELECT {_V1} FROM tiered",
    "scoring_v2": f"SELECT {_V1}, {_V2} FROM tiered",
    "scoring_v3": f"""SELECT {_V1}, {_V2}, tier AS customer_priority_tier_v3,
        'phase_12_v3_adjusted_priority_tier_logic' AS scoring_model_version_v3 FROM tiered""",
    "recommended_actions": f"""SELECT {_PROFILE}, {_date("renewal_date")},
        {_big("d", "days_until_renewal")}, {_USAGE}, {_double("open_pipeline_value")}, {_SCORES},
        risk_2 AS risk_level_v2, growth AS expansion_level_v2, tier AS customer_priority_tier_v3,
        act AS recommended_action_type, priority AS recommended_action_priority,
        next_action AS recommended_next_action, role AS suggested_owner_role,
        {_date("due", "recommended_due_date")}, reason AS recommendation_reason,
        'phase_13_v1_rule_based_recommended_actions' AS recommendation_model_version
        FROM recommended""",
    "playbook_signals": """SELECT account_id, high_support, moderate_support, low_usage,
        high_usage, very_low_users, low_nps, high_nps, renewal_imminent, renewal_near,
        very_high_churn, healthy, strong_expansion, has_overdue FROM branched""",
    "playbook_timeline": """SELECT account_id, act AS recommended_action_type,
        timeline AS timeline_label, 'action_playbook_v1' AS playbook_version FROM played""",
    "playbook_steps": " UNION ALL ".join(
        f"""SELECT account_id, '{name}' AS list_name,
        CAST(unnest(range(1, len({source}) + 1)) AS BIGINT) AS step_number,
        unnest({source}) AS step_text FROM played"""
        for name, source in (
            ("immediate_next_steps", "steps"),
            ("phase_2_next_steps", "later"),
            ("success_metrics", "metrics"),
        )
    ),
    "playbook_lists": f"""SELECT account_id, {_list("later", "phase_2_next_steps")},
        {_list("metrics", "success_metrics")} FROM played""",
    "playbook_escalation": """SELECT account_id, company_name AS account_name,
        escalation AS escalation_guidance FROM played""",
    "intelligence": f"SELECT {_INTELLIGENCE} FROM intel",
    "dashboard_kpis": KPIS,
    "risk_summary": RISKS,
    "action_summary": f"""SELECT priority AS recommended_action_priority,
        act AS recommended_action_type, count(*) AS account_count,
        count(*) FILTER (flagged) AS accounts_needing_human_review,
        {_date("min(due)", "earliest_due_date")}, {_date("max(due)", "latest_due_date")},
        {_mean("sum(c)", "count(*)")} AS avg_churn_risk_score,
        {_mean("sum(e)", "count(*)")} AS avg_expansion_score, {_ARR} AS total_arr,
        {_PIPELINE} AS total_open_pipeline,
        'phase_15_v1_dashboard_action_summary' AS dashboard_action_summary_version
        FROM intel GROUP BY priority, act""",
    "owner_workload": OWNERS,
    "accounts_ranked": f"""SELECT * EXCLUDE (account_name, intelligence_view_version,
        dashboard_priority_rank, renewal_date, usage_events_last_30_days,
        active_users_last_30_days, support_tickets_last_30_days, nps_score, overdue_action_count,
        open_pipeline_value) FROM (SELECT {_INTELLIGENCE} FROM intel)""",
    "high_risk": f"SELECT {_INTELLIGENCE} FROM intel WHERE {_RISKY}",
    "expansion_ready": f"SELECT {_INTELLIGENCE} FROM intel WHERE e >= 7500",
    "review_needed": f"SELECT {_INTELLIGENCE} FROM intel WHERE flagged",
    "by_motion": f"SELECT {_INTELLIGENCE} FROM intel WHERE motion = '{registry.MOTION}'",
    "account_by_id": f"SELECT {_INTELLIGENCE} FROM intel WHERE account_id = '{registry.ACCOUNT_ID}'",
    "row_counts": COUNTS,
    "pk_check": PRIMARY,
    "fk_orphans": FOREIGN,
    "not_null": NOT_NULL,
    "critical_nulls": NULLS,
    "quality_summary": SUMMARY,
    "duplicate_accounts": """SELECT account_id, count(*) AS duplicate_count FROM accounts
        GROUP BY account_id HAVING count(*) > 1""",
    "missing_accounts": """SELECT account_id, company_name FROM accounts
        WHERE account_id NOT IN (SELECT account_id FROM intel)""",
    "playbook_gaps": """SELECT account_id, company_name, false AS lacks_required_field,
        true AS lacks_playbook_text FROM intel WHERE steps IS NULL OR later IS NULL
        OR metrics IS NULL OR escalation IS NULL""",
    "score_range": f"""SELECT {", ".join(
        _score(f"{x}({column})", f"{x}_{name}")
        for column, name in (("h", "health"), ("c", "churn"), ("e", "expansion"))
        for x in ("min", "max"))},
        count(*) FILTER (least(h, c, e) < 0 OR greatest(h, c, e) > 10000) AS rows_out_of_range
        FROM intel""",
    "scores_out_of_range": f"""SELECT account_id, company_name, {_SCORES} FROM intel
        WHERE least(h, c, e) < 0 OR greatest(h, c, e) > 10000""",
    "kpi_subset": f"""SELECT total_accounts, critical_risk_accounts, high_risk_accounts,
        high_expansion_accounts, accounts_needing_human_review, total_arr, arr_at_risk
        FROM ({KPIS})""",
    "risk_subset": f"""SELECT risk_level, account_count, avg_churn_risk_score, total_arr
        FROM ({RISKS})""",
    "top10_risk": _numbered(
        f"""account_id, company_name, risk_2 AS risk_level,
        {_score("c", "computed_churn_risk_score")}, {_score("h", "computed_health_score")},
        act AS recommended_action_type, role AS suggested_owner_role,
        {_big("d", "days_until_renewal")}""",
        f"intel WHERE {_RISKY}",
        "c DESC, account_id",
        10,
    ),
    "top10_expansion": _numbered(
        f"""account_id, company_name, growth AS expansion_level,
        {_score("e", "computed_expansion_score")}, {_score("c", "computed_churn_risk_score")},
        act AS recommended_action_type, role AS suggested_owner_role,
        {_double("open_pipeline_value")}""",
        "intel WHERE e >= 7500",
        "e DESC, account_id",
        10,
    ),
    "top10_review": _numbered(
        f"""account_id, company_name, priority AS recommended_action_priority,
        risk_2 AS risk_level, flagged AS needs_human_review, review_text AS human_review_reason,
        {_big("d", "days_until_renewal")}""",
        "intel WHERE flagged",
        "prio_rank, account_id",
        10,
    ),
    "owner_subset": f"""SELECT suggested_owner_role, assigned_account_count,
        critical_action_count, high_action_count, human_review_count, total_arr_owned
        FROM ({OWNERS})""",
    "motion_distribution": f"""SELECT motion AS primary_business_motion, count(*) AS account_count,
        {_mean("sum(c)", "count(*)")} AS avg_churn, {_ARR} AS total_arr
        FROM intel GROUP BY motion""",
    "account_search": f"SELECT {_INTELLIGENCE} FROM intel WHERE {_found(registry.SEARCH_TERM)}",
    "priority_queue": _numbered(
        f"{_INTELLIGENCE}, {_URGENT_VALUE}",
        f"intel WHERE {_found(registry.PRESET_TERM)}",
        f"{_URGENCY} DESC, {_ORDER}",
        5,
    ),
    "motion_summary": f"""SELECT motion AS primary_business_motion, count(*) AS account_count,
        {_ARR} AS total_arr FROM intel GROUP BY motion""",
    "preset_filter": f"""SELECT {_INTELLIGENCE} FROM intel
        WHERE d <= 60 AND {_found(registry.PRESET_TERM)}
        ORDER BY {_ORDER} LIMIT {registry.PRESET_LIMIT}""",
    "preset_counts": """SELECT count(*) AS "all",
        count(*) FILTER (c >= 6000) AS critical_risk,
        count(*) FILTER (c >= 5000 AND c < 6000) AS high_risk,
        count(*) FILTER (e >= 6000) AS expansion_ready,
        count(*) FILTER (flagged) AS human_review,
        count(*) FILTER (d <= 60) AS renewal_soon FROM intel""",
    "risk_totals": """SELECT risk_2 AS risk_level, count(*) AS account_count,
        (SELECT count(*) FROM intel) AS total_accounts,
        (SELECT count(*) FROM intel WHERE c >= 5000) AS critical_and_high_accounts
        FROM intel GROUP BY risk_2""",
    "action_mix": """SELECT row_number() OVER (ORDER BY count(*) DESC, min(prio_rank), act)
          AS position, act AS recommended_action_type, count(*) AS account_count,
        CASE WHEN lower(act) LIKE '%expand%' THEN 'success'
          WHEN regexp_matches(lower(act), 'churn|save|recover') THEN 'warning'
          ELSE 'neutral' END AS tone,
        (SELECT count(*) FROM intel WHERE prio_rank <= 2) AS high_priority_accounts
        FROM intel GROUP BY act QUALIFY position <= 5""",
    "risk_queue": f"SELECT {_INTELLIGENCE}, {_URGENT_VALUE} FROM intel WHERE {_RISKY}",
    "risk_queue_totals": f"""SELECT {_ARR} AS arr_at_risk,
        count(*) FILTER (c >= 6000) AS critical_accounts,
        count(*) FILTER (c < 6000) AS high_accounts FROM intel WHERE {_RISKY}""",
    "expansion_queue": f"SELECT {_INTELLIGENCE} FROM intel WHERE {_GROWING}",
    "expansion_queue_totals": f"""SELECT count(*) AS account_count, {_ARR} AS total_arr
        FROM intel WHERE {_GROWING}""",
    "review_queue": f"SELECT {_INTELLIGENCE}, {_URGENT_VALUE} FROM intel WHERE flagged",
    "display_bands": f"SELECT account_id, {_SCORES}, {_DISPLAYS} FROM intel",
    "steps_from_json": f"""SELECT account_id, CAST(len(found) AS BIGINT) AS step_count,
        {_list("found", "steps")} FROM (SELECT account_id,
          CASE WHEN account_owner IS NULL THEN [] WHEN d IS NULL THEN [timeline] ELSE later END
            AS found FROM intel)""",
    "explanation_context": f"SELECT account_id, {_document()} AS context_text FROM intel",
    "explanation_parse": PARSED,
}

SELECTS |= {
    f"{name}_unfolded": SELECTS[name]
    for name in ("dashboard_kpis", "risk_summary", "action_summary", "owner_workload")
}
SELECTS["account_search_indexed"] = SELECTS["account_search"]


def statements() -> dict[str, str]:
    return {name: _with(select) for name, select in SELECTS.items()}


#: Queries whose rows come in an order, as the sequence of their accounts.
_SEQUENCES = {
    "accounts_ranked": f"intel ORDER BY {_ORDER}",
    "high_risk": f"intel WHERE {_RISKY} ORDER BY c DESC, d ASC NULLS LAST, account_id",
    "expansion_ready": "intel WHERE e >= 7500 ORDER BY e DESC, open_pipeline_value DESC NULLS FIRST, account_id",
    "review_needed": f"intel WHERE flagged ORDER BY {_ORDER}",
    "by_motion": f"intel WHERE motion = '{registry.MOTION}' ORDER BY {_ORDER}",
    "preset_filter": f"intel WHERE d <= 60 AND {_found(registry.PRESET_TERM)} ORDER BY {_ORDER} LIMIT {registry.PRESET_LIMIT}",
    "risk_queue": f"intel WHERE {_RISKY} ORDER BY {_URGENCY} DESC, {_ORDER}",
    "expansion_queue": f"intel WHERE {_GROWING} ORDER BY e DESC, {_ORDER}",
    "review_queue": f"intel WHERE flagged ORDER BY {_URGENCY} DESC, {_ORDER}",
}


def sequences() -> dict[str, str]:
    return {name: _with(f"SELECT account_id FROM {rest}") for name, rest in _SEQUENCES.items()}
