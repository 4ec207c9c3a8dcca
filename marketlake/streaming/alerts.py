"""Stateful alerts: outages and price spikes across micro-batches.

The state of a key is a few numbers. Rows of a key are ordered and folded by micro-batch, so the source's
own limit (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds what one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlake.operators.outages import FAILURE_THRESHOLD, RESET_SECONDS
from marketlake.operators.quality import SPIKE_THRESHOLD
from marketlake.operators.series import BAR_KEYS


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class _OutageProcessor(StatefulProcessor):
    """Keeps the open run of failures: how many, its start and its last one (microseconds)."""

    def __init__(self, keys: list[str], threshold: int, gap_seconds: int) -> None:
        self.keys, self.threshold, self.gap = keys, threshold, gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n LONG, started LONG, ended LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts = _in_order(rows, ["at"])
        at, failed = attempts["at"].to_numpy(), attempts["failed"].to_numpy(dtype=bool)
        n, started, ended = self.run.get() if self.run.exists() else (0, 0, 0)

        # A run starts at a failure that follows a success, or the failure before by more than the gap.
        before = np.concatenate([[ended], at[:-1]])
        after_failure = np.concatenate([[n > 0], failed[:-1]])
        number = np.cumsum(failed & ~(after_failure & (at - before <= self.gap)))
        runs = pd.DataFrame({"run": number[failed], "at": at[failed]}).groupby("run")["at"].agg(
            started="min", ended="max", n_failures="count"
        )
        if n > 0 and 0 in runs.index:
            runs.loc[0, "n_failures"] += n
            runs.loc[0, "started"] = started

        if failed[-1]:
            first, last, count = runs.iloc[-1]
            self.run.update((int(count), int(first), int(last)))
        else:
            self.run.clear()
        found = runs[runs["n_failures"] >= self.threshold].reset_index(drop=True)
        yield found.assign(**dict(zip(self.keys, key)))[[*self.keys, *runs.columns]]


def outage_alerts(
    attempts: DataFrame,
    keys: Sequence[str] = ("provider", "data_type", "symbol"),
    threshold: int = FAILURE_THRESHOLD,
    gap_seconds: int = RESET_SECONDS,
) -> DataFrame:
    """Outages as they grow (update mode): one row per run of failures and micro-batch that touched it.

    The last row of a ``started_at`` is the run's final extent, as ``outages`` finds it in a batch.
    Attempts of a key arrive in time order from batch to batch.
    """
    names = ", ".join(f"{k} STRING" for k in keys)
    runs = (
        attempts.where(F.col("completed_at").isNotNull())
        .select(*keys, F.unix_micros("completed_at").alias("at"), (F.col("status") == "failed").alias("failed"))
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=_OutageProcessor(list(keys), threshold, gap_seconds),
            outputStructType=f"{names}, started LONG, ended LONG, n_failures LONG",
            outputMode="Update",
            timeMode="None",
        )
    )
    return runs.select(
        *keys,
        F.timestamp_micros("started").alias("started_at"),
        F.timestamp_micros("ended").alias("ended_at"),
        "n_failures",
    )


class _UnorderedOutageProcessor(StatefulProcessor):
    """Keeps the attempts that the watermark has not passed, packed by arrival, and the open run of failures behind it."""

    def __init__(self, keys: list[str], threshold: int, gap_seconds: int) -> None:
        self.keys, self.threshold, self.gap = keys, threshold, gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows BINARY")
        self.run = handle.getValueState("run", "n LONG, started LONG, ended LONG")

    def _out(self, key, kind: str, rows: list[tuple]) -> pd.DataFrame:
        names = ["started", "ended", "n_failures"]
        found = pd.DataFrame(rows, columns=names).astype({"n_failures": "Int64"}).assign(kind=kind, **dict(zip(self.keys, key)))
        return found[["kind", *self.keys, *names]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, last = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            packed = part[["at", "place", "failed"]].to_numpy(np.int64)
            late = packed[:, 0] // 1000 <= mark
            if late.any():
                yield self._out(key, "late", [(at, at, None) for at in packed[late, 0].tolist()])
            if not late.all():
                self.held.appendValue((packed[~late].tobytes(),))
                last = max(last or 0, int(packed[~late, 0].max()))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, ended = timerValues.getCurrentWatermarkInMs(), []
        if self.held.exists():
            attempts = np.concatenate([np.frombuffer(r[0], np.int64).reshape(-1, 3) for r in self.held.get()])
            due = attempts[:, 0] // 1000 <= mark
            if due.any():
                ended = self._ended(attempts[due])
                if due.all():
                    self.held.clear()
                else:
                    self.held.put([(attempts[~due].tobytes(),)])
        if self.run.exists():
            n, started, last = self.run.get()
            if (last + self.gap) // 1000 < mark:  # nothing can follow it any more
                ended.append((started, last, n))
                self.run.clear()
            else:
                self.handle.registerTimer((last + self.gap) // 1000 + 1)
        found = [run for run in ended if run[2] >= self.threshold]
        if found:
            yield self._out(key, "outage", found)

    def _ended(self, attempts: np.ndarray) -> list[tuple]:
        """Runs that end among these attempts, all before the watermark; the one that may go on is kept."""
        attempts = attempts[np.lexsort((attempts[:, 1], attempts[:, 0]))]
        at, failed = attempts[:, 0], attempts[:, 2].astype(bool)
        n, started, last = self.run.get() if self.run.exists() else (0, 0, 0)
        before, after_failure = np.concatenate([[last], at[:-1]]), np.concatenate([[n > 0], failed[:-1]])
        number = np.cumsum(failed & ~(after_failure & (at - before <= self.gap)))
        # Number 0 goes on with the kept run; every other number is a run of its own.
        runs = []
        cuts = [0, *np.flatnonzero(np.diff(number, prepend=0)).tolist(), len(at)]
        for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
            own = at[low:high][failed[low:high]].tolist()
            kept = k == 0 and n > 0
            runs.append((n * kept + len(own), started if kept else own[0] if own else 0, own[-1] if own else last))
        runs = [(s, e, c) for c, s, e in runs if c > 0]
        if failed[-1]:
            s, e, c = runs.pop()
            self.run.update((c, s, e))
        else:
            self.run.clear()
        return runs


def unordered_outages(
    attempts: DataFrame,
    keys: Sequence[str] = ("provider", "data_type", "symbol"),
    place: str | None = None,
    delay: str = "1 hour",
    threshold: int = FAILURE_THRESHOLD,
    gap_seconds: int = RESET_SECONDS,
) -> DataFrame:
    """Outages (``kind`` outage: keys…, started_at, ended_at, n_failures), once they are over, of attempts that come in any order
    within ``delay``; and attempts that came later than that (``kind`` late: their time as started_at). Append mode.

    What ``outages`` finds over all attempts that are not late, ``place`` ordering those of one moment. A key holds its attempts of
    the last ``delay`` as packed numbers, and one open run; timers at the watermark end runs, and an idle key leaves no state.
    """
    names = ", ".join(f"{k} STRING" for k in keys)
    placed = (
        attempts.where(F.col("completed_at").isNotNull())
        .withWatermark("completed_at", delay)
        # As a plain number, which Spark doesn't judge by the watermark.
        .select(
            *keys, F.unix_micros("completed_at").alias("at"), (F.col(place).cast("long") if place else F.lit(0).cast("long")).alias("place"),
            (F.col("status") == "failed").alias("failed"),
        )
    )
    found = placed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_UnorderedOutageProcessor(list(keys), threshold, gap_seconds),
        outputStructType=f"kind STRING, {names}, started LONG, ended LONG, n_failures LONG",
        outputMode="Append",
        timeMode="EventTime",
    )
    times = {c: F.timestamp_micros(c[:-3]) for c in ("started_at", "ended_at")}
    return found.withColumns(times).select("kind", *keys, "started_at", "ended_at", "n_failures")


class _SpikeProcessor(StatefulProcessor):
    """Keeps the last close of a series."""

    def __init__(self, keys: list[str], threshold: float, prices: list[str]) -> None:
        self.keys, self.threshold, self.prices = keys, threshold, prices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "close DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bars = _in_order(rows, ["timestamp"])
        prior = bars["close"].shift(1)
        if self.last.exists():
            prior.iloc[0] = self.last.get()[0]
        spiked = np.zeros(len(bars), bool)
        for price in self.prices:
            with np.errstate(divide="ignore", invalid="ignore"):
                moved = np.abs((bars[price].to_numpy() - prior.to_numpy()) / prior.to_numpy())
            # No prior close is no spike; a move from a zero close always is one. Of a price that isn't there, nothing is known.
            there = bars[price].notna().to_numpy() | (price == "close")
            spiked |= prior.notna().to_numpy() & there & ~(moved <= self.threshold)
        self.last.update((float(bars["close"].iloc[-1]),))
        found = bars.loc[spiked, ["timestamp", *self.prices]].assign(prior_close=prior[spiked])
        yield found.assign(**dict(zip(self.keys, key)))[[*self.keys, "timestamp", *self.prices, "prior_close"]]


def spike_alerts(
    bars: DataFrame, keys: Sequence[str] = BAR_KEYS, threshold: float = SPIKE_THRESHOLD, prices: Sequence[str] = ("close",)
) -> DataFrame:
    """Bars of which one of ``prices`` moved by more than the threshold from the close before, across micro-batches.

    The price check's rule is over all four of ``schemas.PRICES``. Bars of a series arrive in time order from batch to
    batch, as ``tumbling_bars`` in append mode delivers them.
    """
    names, read = ", ".join(f"{k} STRING" for k in keys), dict.fromkeys([*prices, "close"])
    return bars.select(*keys, "timestamp", *read).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_SpikeProcessor(list(keys), threshold, list(prices)),
        outputStructType=f"{names}, timestamp TIMESTAMP, {', '.join(f'{c} DOUBLE' for c in prices)}, prior_close DOUBLE",
        outputMode="Append",
        timeMode="None",
    )
