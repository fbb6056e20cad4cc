"""A stateful operator of our own: running totals of a key, with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(events: DataFrame, key: str = "user_id", value: str = "value", idle_ms: int = 86_400_000) -> DataFrame:
    """For a stream with a watermark on ts: after each micro-batch a row (key, n, total, closed) for every key with new events.

    A key without events for `idle_ms` of event time gets a last row with closed = true, and its state goes; so state is
    bounded by the keys that are active. A null value counts as an event and adds nothing; so does
    one with a null ts, which keeps no state longer.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total], "closed": [True]})
            return
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
            if b["ts"].notna().any():
                last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total], "closed": [False]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double, closed boolean", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)
