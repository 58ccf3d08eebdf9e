"""Request metrics over a stream: counts, and percentiles of each route's latest samples kept in state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.metrics import WINDOW


def windowed_counts(requests: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """route, status, n per event-time window; rows later than `late` are dropped."""
    w = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "route", "status").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "route", "status", "n")


def _rank(values: list[float], fraction: float) -> float:
    return sorted(values)[min(len(values) - 1, int(fraction * len(values)))]


def latest_latency(requests: DataFrame, window: int = WINDOW, idle_ms: int | None = None) -> DataFrame:
    """After each batch, a row per route that got samples: n, p50, p95, p99 over its `window` newest; the state is those samples, and if idle_ms is given only until no request came for so long."""

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        for f in frames:
            kept += list(zip(f["ts"].astype("int64").tolist(), f["request_id"].tolist(), f["ms"].tolist()))
        kept = sorted(kept)[-window:]
        ts, ids, ms = (list(x) for x in zip(*kept))
        state.update((ts, ids, ms))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], len(ms), *(_rank(ms, q) for q in (0.5, 0.95, 0.99)))], columns=["route", "n", "p50", "p95", "p99"])

    rows = requests.select("route", "ts", F.col("request_id").cast("long"), F.col("ms").cast("double"))
    return rows.groupBy("route").applyInPandasWithState(update, "route string, n int, p50 double, p95 double, p99 double", "ts array<long>, ids array<long>, ms array<double>", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
