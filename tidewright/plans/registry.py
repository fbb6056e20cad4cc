"""All relational queries and, for each, the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from tidewright.functions import python, scalar, variants
from tidewright.operators import aggregates, joins, ordered, patterns, quantiles, sets, sketches, windows
from tidewright.sources import tar, upsert
from tidewright.streaming import joins as stream_joins
from tidewright.streaming import timers
from tidewright.streaming import windows as event_windows

_ALL = {name: pair for module in (aggregates, quantiles, sketches, joins, windows, ordered, patterns, sets, scalar, python, variants, event_windows, stream_joins, timers, tar, upsert) for name, pair in module.QUERIES.items()}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
