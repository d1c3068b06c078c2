"""Failure limiter: after `max_failures` failures within `window` seconds a key is blocked for `block` seconds.

An entry counts while it is less than `window` old; reaching the limit blocks and clears; a success clears; while blocked, failures
don't count. That is a fold over a key's events in time order: a state for each key, in batch and in streams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, ts timestamp, blocked boolean, failures int"


def step(state: tuple[list[float], float], t: float, ok: bool, max_failures: int, window: float, block: float) -> tuple[tuple[list[float], float], bool]:
    """(new state, whether the event met a block); a state is (times of failures, blocked until)."""
    times, until = state
    if t < until:
        return state, True
    if ok:
        return ([], 0.0), False
    times = [x for x in times if t - x < window] + [t]
    return (([], t + block) if len(times) >= max_failures else (times, 0.0)), False


def run(events, state, max_failures, window, block):
    out = []
    for e in events:
        state, blocked = step(state, e.ts.timestamp(), bool(e.ok), max_failures, window, block)
        out.append((e.key, e.ts, blocked, len(state[0])))
    return out, state


def limit(events: DataFrame, max_failures: int = 5, window: float = 300, block: float = 900) -> DataFrame:
    """key, ts, blocked, failures after each event; events: key, ts, ok. A key's events are sorted in one task, which spills, and
    streamed with only the limiter's state held; at one time failures come before successes."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, ([], 0.0)
        for b in batches:
            keys, blocked, failures = b.column(0).to_pylist(), [], []
            for k, t, ok in zip(keys, b.column(1).cast(pa.int64()).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != of:
                    of, state = k, ([], 0.0)
                state, met = step(state, math.nan if t is None else t / 1e6, bool(ok), max_failures, window, block)
                blocked.append(met)
                failures.append(len(state[0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(1), pa.array(blocked, pa.bool_()), pa.array(failures, pa.int32())], names=["key", "ts", "blocked", "failures"])

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "ok")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "ok").mapInArrow(fold, OUT)


def limit_stream(events: DataFrame, max_failures: int = 5, window: float = 300, block: float = 900) -> DataFrame:
    """The same over a stream, with the state kept by Spark."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], 0.0)
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        rows, (times, until) = run(pdf.itertuples(), (list(held[0]), held[1]), max_failures, window, block)
        state.update((times, until))
        yield pd.DataFrame(rows, columns=["key", "ts", "blocked", "failures"])

    return events.select("key", F.col("ts").cast("timestamp").alias("ts"), "ok").groupBy("key").applyInPandasWithState(fold, OUT, "times array<double>, until double", "append", GroupStateTimeout.NoTimeout)
