"""All registered queries, grouped by subject."""

from importlib import import_module

GROUPS = ("traffic_queries", "capacity_queries", "environment_queries", "quality_queries", "cleaning_queries", "feature_queries",
          "spatial_queries", "fiscal_queries", "statistics_queries", "anomaly_queries", "forecast_queries",
          "scenario_queries", "publication_queries", "source_queries")


def load() -> None:
    for group in GROUPS:
        try:
            import_module(f"{__name__}.{group}")
        except ModuleNotFoundError as e:
            if group not in str(e):
                raise
