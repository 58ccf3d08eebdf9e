"""Viewport ticks: level choice with hysteresis, suppression of covered ticks, what to add and remove.

One step function serves the batch replay and the stream, so both give the same
requests for the same ticks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .._worker import shuffle_partitions

LEVELS = ("high", "medium", "low")
#: (finer below, coarser from) between consecutive levels (fixed values).
THRESHOLDS = ((45_000.0, 60_000.0), (140_000.0, 180_000.0))
MARGIN = 0.15


def check_thresholds(thresholds) -> None:
    """Each dead band must be open and lie above the one before."""
    last = float("-inf")
    for finer, coarser in thresholds:
        if not finer < coarser or not finer > last:
            raise ValueError(f"thresholds must increase: {thresholds}")
        last = coarser


def select_level(level: int, zoom: float, thresholds=THRESHOLDS) -> int:
    """Coarsen while zoom reaches the coarser bound, then refine while it is below the finer one."""
    while level < len(thresholds) and zoom >= thresholds[level][1]:
        level += 1
    while level > 0 and zoom < thresholds[level - 1][0]:
        level -= 1
    return level


def step(state: tuple | None, zoom: float, box: tuple, margin: float = MARGIN, thresholds=THRESHOLDS) -> tuple[tuple, bool]:
    """(new state, whether a request goes out); state is (level, padded box of the last request)."""
    level = select_level(state[0] if state else 0, zoom, thresholds)
    if state and state[0] == level:
        x0, y0, x1, y1 = state[1]
        if box[0] >= x0 and box[1] >= y0 and box[2] <= x1 and box[3] <= y1:
            return state, False
    pad = max(box[2] - box[0], box[3] - box[1]) * margin
    return (level, (box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad)), True


_OUT = "session string, seq long, level string, requested boolean, min_x double, min_y double, max_x double, max_y double"
_NAMES = ["session", "seq", "level", "requested", "min_x", "min_y", "max_x", "max_y"]


def replay(ticks: DataFrame, margin: float = MARGIN, thresholds=THRESHOLDS) -> DataFrame:
    """ticks (session, seq, zoom, min_x, min_y, max_x, max_y) -> level, requested and the padded box in force at each.

    A task reads its sessions in order and holds one state at a time, however
    long a session is. Ticks with nulls or non-finite numbers are left out.
    """
    check_thresholds(thresholds)
    numbers = ["zoom", "min_x", "min_y", "max_x", "max_y"]
    sane = F.lit(True)
    for n in numbers:
        sane = sane & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    clean = ticks.select(F.col("session").cast("string"), F.col("seq").cast("long"), *[F.col(n).cast("double") for n in numbers]).where(sane)
    ordered = clean.repartition(shuffle_partitions(ticks.sparkSession), "session").sortWithinPartitions("session", "seq")

    def run(batches: Iterator[pa.RecordBatch]):
        current, state = None, None
        for b in batches:
            out = []
            for session, seq, zoom, *box in zip(*(c.to_pylist() for c in b.columns)):
                if session != current:
                    current, state = session, None
                state, asked = step(state, zoom, tuple(box), margin, thresholds)
                out.append((session, seq, LEVELS[state[0]], asked, *state[1]))
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_NAMES), preserve_index=False)

    return ordered.mapInArrow(run, _OUT)


def stream(ticks: DataFrame, margin: float = MARGIN, thresholds=THRESHOLDS, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream of ticks: state per session, kept between batches, and if idle_ms is given only until no tick came for so long; ticks at or before the last seq are late and dropped."""
    check_thresholds(thresholds)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        seq, kept = (-1, None) if not state.exists else (state.get[0], (state.get[1], tuple(state.get[2:])))
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.seq <= seq:
                continue
            seq = int(r.seq)
            kept, asked = step(kept, r.zoom, (r.min_x, r.min_y, r.max_x, r.max_y), margin, thresholds)
            out.append((key[0], seq, LEVELS[kept[0]], asked, *kept[1]))
        if kept is not None:
            state.update((seq, kept[0], *kept[1]))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    return ticks.groupBy("session").applyInPandasWithState(update, _OUT, "seq long, level int, a double, b double, c double, d double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def changes(before: Column, after: Column, level_changed: Column) -> list[Column]:
    """to_remove, to_add between two sets of ids; a change of level replaces all."""
    gone = F.when(level_changed, before).otherwise(F.array_except(before, after))
    new = F.when(level_changed, after).otherwise(F.array_except(after, before))
    return [F.array_sort(gone).alias("to_remove"), F.array_sort(new).alias("to_add")]


def newest_generation(updates: DataFrame) -> DataFrame:
    """Of each session's writes only those of its highest generation count."""
    last = updates.groupBy("session").agg(F.max("generation").alias("generation"))
    return updates.join(last, ["session", "generation"], "left_semi")


def rolled_back(requests: DataFrame, failures: DataFrame) -> DataFrame:
    """session, generation, box, failed of each session's newest request: its box is cleared if that very request failed, so that the next tick asks again.

    requests: session, generation, box; failures: session, generation. A failure of an older request changes nothing.
    """
    newest = requests.groupBy("session").agg(F.max_by(F.struct("generation", "box"), "generation").alias("r")).select("session", "r.*")
    seen = failures.select("session", "generation", F.lit(True).alias("f")).distinct()
    both = newest.join(seen, ["session", "generation"], "left").withColumn("failed", F.coalesce("f", F.lit(False)))
    return both.select("session", "generation", F.when(~F.col("failed"), F.col("box")).alias("box"), "failed")
