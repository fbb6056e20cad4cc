"""Row patterns over a stream: the matches of operators.patterns, emitted once the watermark has passed their last event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Best = list[tuple[int, int] | None]


def advance(best: Best, us: int, key: int, steps: int, within: int) -> tuple[int, int] | None:
    """Takes an event that fulfils the bits of `steps` on from `best`, the latest (time, key) at which the first 1, 2, ... steps began; the start of a match that it completes, or None."""
    last, start = len(best), best[-1]
    done = start if steps >> last & 1 and start and us - start[0] <= within else None
    for j in range(last - 1, -1, -1):
        begun = (us, key) if j == 0 else best[j - 1]
        if steps >> j & 1 and begun and (best[j] is None or begun > best[j]):
            best[j] = begun
    return done


def stream_matches(events: DataFrame, by: str, time: str, key: str, steps: list[Column], within: float) -> DataFrame:
    """`by`, `key`, `time` and start_us, start_key of matches of two steps at least, as patterns.matches finds them, for a stream with a watermark on `time`.

    Events wait in the state until the watermark has passed them, so they are taken in order though they come in any; events later than the watermark are left
    out. What has begun is let go when it is too old to be completed, and then a key's state goes. Rows with a null key or time, or that fulfil no step, are left out.
    """
    limit, n = int(within * 1_000_000), len(steps)
    bits = sum((F.when(F.coalesce(s, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(steps)), F.lit(0))
    rows = events.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(F.col(by).alias("by"), F.col(time).alias("time"), F.col(key).cast("long").alias("key"), bits.cast("int").alias("steps")).where("steps > 0")
    kind = events.schema[by].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, ids, flags, since, since_key = state.get if state.exists else ([], [], [], [-1] * (n - 1), [-1] * (n - 1))
        waiting = list(zip(us, ids, flags, strict=True))
        best: Best = [(t, k) if t >= 0 else None for t, k in zip(since, since_key, strict=True)]
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip((b["time"].astype("int64") // _unit(b["time"])).tolist(), b["key"].tolist(), b["steps"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        out, later = [], []
        for t, k, f in sorted(waiting):
            if t > mark:
                later.append((t, k, f))
            elif start := advance(best, t, k, f, limit):
                out.append((keys[0], k, t, *start))
        best = [x if x and x[0] + limit >= mark else None for x in best]
        if later or any(best):
            known = [x or (-1, -1) for x in best]
            state.update(([t for t, _, _ in later], [k for _, k, _ in later], [f for _, _, f in later], [t for t, _ in known], [k for _, k in known]))
            due = later[0][0] if later else max(x[0] for x in best if x) + limit
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["by", "key", "us", "start_us", "start_key"])

    found = rows.groupBy("by").applyInPandasWithState(step, f"by {kind}, key long, us long, start_us long, start_key long", "us array<long>, ids array<long>, flags array<int>, since array<long>, since_key array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("by").alias(by), F.col("key").alias(key), F.timestamp_micros("us").alias(time), F.timestamp_micros("start_us").alias("started"), "start_key")


def _unit(times: pd.Series) -> int:
    """How many of the units of a series of times make a microsecond."""
    return 1000 if "ns" in str(times.dtype) else 1
