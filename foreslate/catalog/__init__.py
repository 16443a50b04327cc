"""Every query by name; importing this module fills the registry."""

from . import (  # noqa: F401
    aggregate_queries,
    join_queries,
    model_queries,
    projection_queries,
    report_queries,
    reshape_queries,
    scalar_queries,
    source_queries,
    window_queries,
)
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
