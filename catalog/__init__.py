"""Registered queries: each runs a library operator over the whole given tables."""


def load():
    """All registered queries by name."""
    from . import comparison, experiments, fitting, linear, loading, preparation, scoring, trees, volumes, windowing  # noqa: F401
    from .base import CATALOG

    return CATALOG
