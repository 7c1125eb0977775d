"""Imports every plan module so the registry is complete."""

from autotab.plans import (insight_plans, io_plans, metric_plans, model_plans,  # noqa: F401
                           prep_plans,
                           profile_plans, recommend_plans, tune_plans, unsupervised_plans)
from autotab.plans.model_plans import flagship
from autotab.plans.registry import PLANS

__all__ = ["PLANS", "flagship"]
