"""Registered queries over the given tables, each with its SQL check where SQL can say it."""

from importlib import import_module

AREAS = (
    "text_queries",
    "label_queries",
    "row_queries",
    "profile_queries",
    "model_queries",
    "tuning_queries",
)


def load():
    """All queries and all checks, by name."""
    for area in AREAS:
        import_module(f"opinara.plans.{area}")
    from opinara.plans.base import CHECKS, QUERIES

    return dict(QUERIES), dict(CHECKS)
