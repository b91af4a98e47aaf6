"""Logs and spans of the same trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlate_traces(spans: DataFrame, logs: DataFrame, by_span: bool = False) -> DataFrame:
    """Logs with the spans of their trace (of their own span, with by_span). Rows without a trace id are
    left out before the join, so that they do not meet in one task."""
    keys = ["trace_id", "span_id"] if by_span else ["trace_id"]
    full = [F.col(x).isNotNull() & (F.col(x) != "") for x in keys]
    for test in full:
        spans, logs = spans.filter(test), logs.filter(test)
    return logs.join(spans, keys)
