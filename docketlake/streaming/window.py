"""The adaptive download window: a fold over attempts, in batches and as a stream.

The window halves (never below 1) on pressure or failure and grows by one after
``STREAK`` successes in a row, up to its maximum. The state (window, successes) has at most
``most * STREAK`` values, so the attempts of a day are a table state -> state; tables
compose, and a key that holds a third of all attempts is folded day by day in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAK = 8


def step_tables(most: int) -> tuple[np.ndarray, np.ndarray]:
    """State after a success and after pressure; state = (window - 1) * STREAK + successes."""
    window, run = np.divmod(np.arange(most * STREAK), STREAK)
    window += 1
    grows = (run + 1 >= STREAK) & (window < most)
    ok_window, ok_run = np.where(grows, window + 1, window), np.where(grows, 0, np.minimum(run + 1, STREAK - 1))
    return (ok_window - 1) * STREAK + ok_run, (np.maximum(1, window // 2) - 1) * STREAK


def adaptive_window(attempts: DataFrame, key: str, at: str, order: list[str], pressure: Column, most: int = 4) -> DataFrame:
    """(key, final_window, attempts, pressure_events) from the window ``most``; null keys are left out, ties in ``order`` are the caller's."""
    rows = attempts.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.to_date(at).alias("day"), F.struct(*order).alias("o"), F.coalesce(pressure, F.lit(False)).alias("bad")
    )
    kind = rows.schema["key"].dataType.simpleString()
    good, bad = (t.tolist() for t in step_tables(most))

    def table_of(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows come sorted: the group is one array per (key, day)
        out = []
        for key_, day, flags in zip(pdf["key"], pdf["day"], pdf["flags"], strict=True):
            state = list(range(most * STREAK))
            for f in flags:
                step = bad if f else good
                state = [step[s] for s in state]
            out.append((key_, day, state, len(flags), int(sum(flags))))
        return pd.DataFrame(out, columns=["key", "day", "states", "n", "p"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield table_of(pdf)

    days = rows.groupBy("key", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "bad"))), lambda x: x["bad"]).alias("flags"))
    tables = days.mapInPandas(run, f"key {kind}, day date, states array<int>, n long, p long")
    start = F.lit((most - 1) * STREAK)
    folded = tables.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("day", "states"))).alias("d"), F.sum("n").alias("attempts"), F.sum("p").alias("pressure_events")
    )
    last = F.aggregate("d", start, lambda s, x: F.element_at(x["states"], s + 1))
    return folded.select("key", (F.floor(last / STREAK) + 1).cast("bigint").alias("final_window"), "attempts", "pressure_events")


def stream_window(attempts: DataFrame, key: str, order: str, pressure: str, most: int = 4) -> DataFrame:
    """The same fold over a stream: after each micro-batch (key, window, successes) of the keys it touched."""
    rows = attempts.select(F.col(key).cast("string").alias("key"), F.col(order).cast("string").alias("o"), F.coalesce(F.col(pressure), F.lit(False)).alias("bad")).where("key is not null")
    good, bad = (t.tolist() for t in step_tables(most))

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else (most - 1) * STREAK
        pdf = pd.concat(list(frames)).sort_values("o", kind="stable")
        for f in pdf["bad"]:
            now = (bad if f else good)[now]
        state.update((now,))
        yield pd.DataFrame({"key": [k[0]], "window": [now // STREAK + 1], "successes": [now % STREAK]})

    return rows.groupBy("key").applyInPandasWithState(fold, "key string, window long, successes long", "state int", "update", "NoTimeout")
