"""Named queries over the given tables."""

import importlib

MODULES = ("sources_silver", "dimension_queries", "fact_queries", "vault_graph_feature_queries", "star_flights", "decision_support", "quality_queries", "text_queries", "integration_queries", "streaming_queries")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"terrace.plans.{name}")
