"""Account intelligence on Spark: features, scores, actions and portfolio views as DataFrames."""

from tallyscope.plans.portfolio import Portfolio

__all__ = ["Portfolio"]
