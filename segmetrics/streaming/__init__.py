"""Structured Streaming loaders for (key, value) export drops."""
from segmetrics.streaming.loader import (  # noqa: F401
    current_dimension_index,
    current_performance,
    start_dimension_loader,
    start_performance_loader,
)
