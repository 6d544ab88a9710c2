"""Lagged correlation of two channels of a stream, window by window, with state of its own.

Events are put on a grid of steps (values of one step are added up) and go to
the windows that hold their step. A window's state is its two rows of sums, a
number for each step, so late and shuffled events cost nothing but their place; it
is given out once, when the watermark passes its end, and forgotten. Events later
than that are dropped by the watermark, as in any event-time window. State is
kept by the stream's checkpoint, so a stream that is started again goes on where
it was.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from resonarium.session import ship

OUT = "win long, lag int, n int, correlation double"
STATE = "xs array<double>, ys array<double>"


def correlations(x: np.ndarray, y: np.ndarray, max_lag: int) -> list[float | None]:
    """Pearson's correlation of x[t] and y[t + lag], lags from -max_lag to max_lag; None where a side is constant."""
    out = []
    for lag in range(-max_lag, max_lag + 1):
        a, b = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])
        a, b = a - a.mean(), b - b.mean()
        den = np.sqrt((a * a).sum() * (b * b).sum())
        out.append(float((a * b).sum() / den) if den > 1e-12 * max(1.0, len(a)) else None)
    return out


def lagged_correlation(events: DataFrame, x: str, y: str, step_seconds: int, window: int, hop: int, max_lag: int, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows (win, lag, n, correlation) of every window that the watermark has passed, for a stream or a finished table.

    events: ts timestamp, channel, value. Window w holds the steps from w * hop on,
    `window` of them, counted from the epoch; n is how many steps a lag has in
    common. A window without events is not given out. A finished table gives all
    its windows.
    """
    if window < 2 or hop < 1 or not 0 <= max_lag < window - 1:
        raise ValueError("needs a window of two steps or more, a hop of one or more, and lags that leave two steps")
    ship(events.sparkSession)
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), "channel", "value").where(F.col("channel").isin(x, y) & F.col("ts").isNotNull() & F.col("value").isNotNull())
    rows = rows.withWatermark("ts", watermark) if events.isStreaming else rows
    at = F.floor(F.unix_micros("ts") / F.lit(step_seconds * 1_000_000)).cast("long")
    spans = F.sequence(F.ceil((at - window + 1) / F.lit(hop)).cast("long"), F.floor(at / F.lit(hop)).cast("long"))
    has = F.ceil((at - window + 1) / F.lit(hop)) <= F.floor(at / F.lit(hop))  # a hop longer than the window leaves steps out
    rows = rows.where(has).select("ts", (F.col("channel") == x).alias("first"), F.col("value").cast("double").alias("value"), at.alias("step"), F.explode(spans).alias("win"))

    def put(sums: np.ndarray, frame, win: int) -> None:
        place = frame["step"].to_numpy() - win * hop
        for row, side in ((0, frame["first"].to_numpy(bool)), (1, ~frame["first"].to_numpy(bool))):
            np.add.at(sums[row], place[side], frame["value"].to_numpy(float)[side])

    def told(sums: np.ndarray, win: int):
        import pandas as pd

        lags = np.arange(-max_lag, max_lag + 1)
        return pd.DataFrame({"win": np.full(len(lags), win), "lag": lags.astype(np.int32), "n": (window - np.abs(lags)).astype(np.int32), "correlation": pd.Series(correlations(sums[0], sums[1], max_lag), dtype=float)})

    if not events.isStreaming:

        def whole(key, frame):
            sums = np.zeros((2, window))
            put(sums, frame, key[0])
            return told(sums, key[0])

        return rows.groupBy("win").applyInPandas(whole, OUT)

    def advance(key, frames, state):
        if state.hasTimedOut:
            xs, ys = state.get
            state.remove()
            yield told(np.array([xs, ys]), key[0])
            return
        sums = np.array(state.get) if state.exists else np.zeros((2, window))
        for f in frames:
            put(sums, f, key[0])
        state.update((sums[0].tolist(), sums[1].tolist()))
        end = (int(key[0]) * hop + window) * step_seconds * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("win").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
