"""Recursions over the days of a series that arrive in any order.

Days are held in list state until the watermark has passed them; a timer at the earliest held day then releases them in order, and the
value state (last day, what the recursion carries) moves on. A recursion cannot be rewound, so a day at or before the last released one
comes too late: it is returned at once, or on release, as a row whose `late` is true and whose other results are null. So no input row
is without a trace. State per series is what `delay` spans, plus one value.

A null day is late. Of rows with one day the first in the order of their values counts, the others are late.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from stressloom import schema as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1)

#: (state or None, days, rows of values) -> (state, one result per row that has one: (day, ...))
Advance = Callable[[tuple | None, list[dt.date], list[tuple]], tuple[tuple, list[tuple]]]


@contextmanager
def keyed_store(spark: SparkSession):
    """The state store that keyed state with timers needs, for queries started inside; the caller's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def millis(day: dt.date) -> int:
    return (day - EPOCH).days * 86_400_000


class InDayOrder(StatefulProcessor):
    def __init__(self, columns: list[str], held: str, state: str, results: list[str], advance: Advance):
        self.columns, self.held_schema, self.state_schema, self.results, self.advance = columns, held, state, results, advance

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"ds date, {self.state_schema}")
        self.held = handle.getListState("held", f"ds date, {self.held_schema}")

    def frame(self, key, results: list[tuple], late: list[tuple]) -> pd.DataFrame:
        blank = (None,) * len(self.results)
        rows = [(key[0], *r, False) for r in results] + [(key[0], ds, *blank, True) for ds in late]
        return pd.DataFrame(rows, columns=["series_id", "ds", *self.results, "late"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.state.get())[0] if self.state.exists() else None
        late, new = [], []
        for pdf in rows:
            for r in pdf[["ds", *self.columns]].itertuples(index=False, name=None):
                ds = None if pd.isna(r[0]) else r[0]
                if ds is None or (last is not None and ds <= last):
                    late.append(ds)
                else:
                    new.append((ds, *[None if pd.isna(v) else v for v in r[1:]]))
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(millis(min(r[0] for r in new)))
        if late:
            yield self.frame(key, [], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: (r[0], repr(r[1:])))
        due = [r for r in held if millis(r[0]) <= passed]
        if not due:
            return
        before = tuple(self.state.get()) if self.state.exists() else None
        last, late, ready = before[0] if before else None, [], []
        for r in due:
            if last is not None and r[0] <= last:
                late.append(r[0])
            else:
                ready.append(r)
                last = r[0]
        results = []
        if ready:
            state, results = self.advance(before[1:] if before else None, [r[0] for r in ready], [r[1:] for r in ready])
            self.state.update((last, *state))
        rest = held[len(due) :]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(millis(rest[0][0]))
        else:
            self.held.clear()
        if results or late:
            yield self.frame(key, results, late)

    def close(self) -> None:
        pass


def in_day_order(daily: DataFrame, columns: list[str], state: str, results: str, advance: Advance, delay: str) -> DataFrame:
    """series_id, ds, the results and late. The watermark column itself does not reach the state, so the engine drops no row before it
    has been seen."""
    timed = daily.select("series_id", "ds", *columns, F.col("ds").cast("timestamp").alias("_day")).withWatermark("_day", delay).drop("_day")
    held = ", ".join(f"{c} double" for c in columns)
    names = [r.strip().split()[0] for r in results.split(",")]
    schema = f"series_id string, ds date, {results}, late boolean"
    return timed.groupBy("series_id").transformWithStateInPandas(InDayOrder(columns, held, state, names, advance), schema, "append", "eventTime")


def _band(x: float) -> str:
    for lower, label in S.FOUR_BANDS:
        if lower is None or x >= lower:
            return label


def alert_changes(daily: DataFrame, delay: str = "30 days") -> DataFrame:
    """A row whenever the alert band of a series differs from the one before. State: the band. Days without an index change nothing."""

    def advance(state, days, rows):
        band, out = state[0] if state else None, []
        for ds, (idx,) in zip(days, rows):
            if idx is None:
                continue
            now = _band(idx)
            if now != band:
                out.append((ds, idx, band, now))
            band = now
        return (band,), out

    return in_day_order(daily, ["idx"], "band string", "idx double, previous string, band string", advance, delay)


N = len(S.CHANNELS)
PAIRS = [(i, j) for i in range(N) for j in range(i, N)]


def ewma_state(daily: DataFrame, lam: float = 0.94, warmup: int = 30, delay: str = "30 days") -> DataFrame:
    """The covariance recursion per series. State: count, last channels and ten products. Days that lack a channel are passed over."""

    def advance(state, days, rows):
        n, last, cov = state if state else (0, None, None)
        cov, out = list(cov) if cov is not None else [0.0] * len(PAIRS), []
        for ds, x in zip(days, rows):
            if any(v is None for v in x):
                continue
            if last is not None:
                d = [a - b for a, b in zip(x, last)]
                keep, add = (n / (n + 1), 1 / (n + 1)) if n < warmup else (lam, 1 - lam)
                cov = [keep * c + add * d[i] * d[j] for c, (i, j) in zip(cov, PAIRS)]
                n += 1
                out.append((ds, *cov))
            last = list(x)
        return (n, last, cov), out

    return in_day_order(daily, S.CHANNELS, "n long, last array<double>, cov array<double>", ", ".join(f"c{i}{j} double" for i, j in PAIRS), advance, delay)


def filter_state(daily: DataFrame, model, delay: str = "30 days") -> DataFrame:
    """Forward regime probabilities with fixed parameters. State: the last probabilities. Days that lack a channel are passed over."""
    from stressloom.operators.regimes import log_density

    def advance(state, days, rows):
        p, out = np.array(state[0]) if state and state[0] is not None else None, []
        whole = [(ds, r) for ds, r in zip(days, rows) if all(v is not None for v in r)]
        if whole:
            for (ds, _), density in zip(whole, log_density(np.array([r for _, r in whole], float), model)):
                v = (model.pi if p is None else p @ model.trans) * np.exp(density - density.max())
                p = v / v.sum()
                out.append((ds, p.tolist()))
        return (None if p is None else [float(x) for x in p],), out

    return in_day_order(daily, S.CHANNELS, "p array<double>", "probs array<double>", advance, delay)
