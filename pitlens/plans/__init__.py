"""Importing this package registers every query."""

from pitlens.plans import point_in_time, price_queries, scoring, aggregate_queries, finding_queries, feed_queries, event_queries, backtest_queries, text_queries, brief_queries, stream_queries, experiment_queries, source_queries  # noqa: F401
from pitlens.plans.registry import QUERIES  # noqa: F401
