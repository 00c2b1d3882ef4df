"""The whole chain from base tables to intelligence rows, lazily."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame

from tallyscope.operators import features as feat
from tallyscope.operators import rollups
from tallyscope.operators.actions import recommended_actions
from tallyscope.operators.intelligence import account_intelligence, account_labels
from tallyscope.operators.playbook import PLAYS, Play, action_playbook, with_playbook
from tallyscope.operators.scoring import score_v1, score_v2, score_v3
from tallyscope.sources.readers import Tables, register_views, write_between_stages


class Portfolio:
    """Every derived relation of one set of base tables on one day.

    Each property is an unevaluated DataFrame, so a report reads only the columns it needs. For
    several reports on the same day, call ``written()`` once and run them on its result.
    """

    def __init__(self, tables: Tables, as_of: date, plays: Sequence[Play] = PLAYS):
        self.tables = tables
        self.as_of = as_of
        self.plays = plays

    @cached_property
    def action_features(self) -> DataFrame:
        return feat.action_features(self.tables["actions"], self.as_of)

    @cached_property
    def engagement_features(self) -> DataFrame:
        return feat.engagement_features(self.tables["customer_engagement"], self.as_of).drop(
            "engagement_id"
        )

    @cached_property
    def opportunity_features(self) -> DataFrame:
        return feat.opportunity_features(self.tables["crm_opportunities"], self.as_of)

    @cached_property
    def score_features(self) -> DataFrame:
        return feat.latest_scores(self.tables["score_history"])

    @cached_property
    def usage_features(self) -> DataFrame:
        return feat.usage_features(self.tables["product_usage_events"], self.as_of)

    @cached_property
    def account_features(self) -> DataFrame:
        return feat.account_features(self.tables, self.as_of)

    @cached_property
    def scoring_v1(self) -> DataFrame:
        return score_v1(self.account_features, self.as_of)

    @cached_property
    def scoring_v2(self) -> DataFrame:
        return score_v2(self.scoring_v1)

    @cached_property
    def scoring_v3(self) -> DataFrame:
        return score_v3(self.scoring_v2)

    @cached_property
    def recommended(self) -> DataFrame:
        return recommended_actions(self.scoring_v3, self.as_of)

    @cached_property
    def playbook(self) -> DataFrame:
        return action_playbook(self.recommended, self.plays)

    @cached_property
    def intelligence(self) -> DataFrame:
        return account_intelligence(self.recommended, self.plays)

    @cached_property
    def labels(self) -> DataFrame:
        """The intelligence rows without playbook texts."""
        return account_labels(self.recommended)

    def with_texts(self, labels: DataFrame) -> DataFrame:
        """Add the playbook texts to filtered, sorted or limited labels."""
        return with_playbook(labels, self.plays)

    def written(self) -> DataFrame:
        """The intelligence rows as a Parquet table in the shared checkpoint folder."""
        return write_between_stages(self.intelligence, "account_intelligence")

    def register(self) -> None:
        """Temp views for SQL users, under the names of the relations."""
        register_views(
            {
                **self.tables,
                "account_action_features": self.action_features,
                "account_engagement_features": self.engagement_features,
                "account_opportunity_features": self.opportunity_features,
                "account_score_features": self.score_features,
                "account_usage_features": self.usage_features,
                "account_features": self.account_features,
                "account_scoring_engine": self.scoring_v1,
                "account_scoring_engine_v2": self.scoring_v2,
                "account_scoring_engine_v3": self.scoring_v3,
                "recommended_actions_engine": self.recommended,
                "account_action_playbook": self.playbook,
                "account_intelligence_view": self.intelligence,
                "dashboard_kpis": rollups.dashboard_kpis(self.intelligence),
                "dashboard_risk_summary": rollups.risk_summary(self.intelligence),
                "dashboard_action_summary": rollups.action_summary(self.intelligence),
                "dashboard_owner_workload": rollups.owner_workload(self.intelligence),
            }
        )
