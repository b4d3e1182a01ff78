"""Structured Streaming forms of the operators that carry state along a recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_statistics(stream: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Mean, deviation and count per event-time window and key; rows later than `late` are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    aggregates = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")]
    return stream.withWatermark(time, late).groupBy(window, *keys).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "mean", "std", "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events with pauses under `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def overlap_add_stream(stream: DataFrame, channel: str, order: str, values: str, size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The kernel on Hann windows that overlap by half, over chunks that arrive in order per channel.

    State per channel: the samples not yet in a whole window, and the weighted sums not yet complete. Samples come
    out once no later window can touch them; `at` is the place of the first. The tail under half a window waits.
    """
    half = size // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(2 * half) + 0.5) / (2 * half))
    kind = dict(stream.dtypes)[channel]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, waiting, sums = state.get if state.exists else (0, [], [])
        waiting, sums = np.array(waiting, float), np.array(sums or [0.0] * half, float)
        out = []
        for pdf in batches:
            for chunk in pdf.sort_values(order)[values]:
                waiting = np.concatenate([waiting, np.asarray(chunk, float)])
                while len(waiting) >= 2 * half:
                    done = w * kernel(waiting[None, : 2 * half])[0]
                    first = sums + done[:half]
                    if at == 0:
                        first = first / w[:half]
                    out.append((at, first.tolist()))
                    sums, waiting, at = done[half:], waiting[half:], at + half
        state.update((at, waiting.tolist(), sums.tolist()))
        yield pd.DataFrame({channel: [key[0]] * len(out), "at": [a for a, _ in out], "values": [v for _, v in out]})

    return stream.select(channel, order, values).groupBy(channel).applyInPandasWithState(run, f"{channel} {kind}, at long, values array<double>", "at long, waiting array<double>, sums array<double>", "append", GroupStateTimeout.NoTimeout)


def kalman_stream(stream: DataFrame, key: str, order: str, observation: str, a: float, w: float, h: float, q: float) -> DataFrame:
    """A scalar Kalman filter per key over rows that arrive in order; the estimate and its variance are the state."""
    kind, order_kind = dict(stream.dtypes)[key], dict(stream.dtypes)[order]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p = state.get if state.exists else (None, None)
        out = []
        for pdf in batches:
            for o, z in zip(*pdf.sort_values(order)[[order, observation]].to_numpy().T):
                if x is None:
                    x, p = z / h, q / h**2
                else:
                    x, p = a * x, a * a * p + w
                    gain = p * h / (h * h * p + q)
                    x, p = x + gain * (z - h * x), (1 - gain * h) * p
                out.append((k[0], o, x))
        if x is not None:
            state.update((float(x), float(p)))
        yield pd.DataFrame(out, columns=[key, order, "state"])

    return stream.select(key, order, observation).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} {order_kind}, state double", "x double, p double", "append", GroupStateTimeout.NoTimeout)
