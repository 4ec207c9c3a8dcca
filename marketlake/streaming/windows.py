"""Bars of any timeframe from a stream, months among them, and the ticks that came too late for theirs.

A bar is a state of a few numbers under (symbol, its start), closed by a timer at its end: so windows may have any width, the state
of a closed bar is gone, and a hot symbol is as many groups as it has open bars. Spark's own windows drop a tick behind the watermark
without a without a trace; here the same watermark decides, but the tick comes out as a row of its own.

Ticks come to the state packed: each task folds its ticks of a bar, an Arrow batch at a time, and sends the fold with the ticks as bytes.
Only those of a closed bar are unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlake import schemas
from marketlake.operators.resample import bar_start, check_timeframe

# The calendar width of every timeframe.
_WIDTHS = {
    "5m": "INTERVAL 5 MINUTES", "15m": "INTERVAL 15 MINUTES", "30m": "INTERVAL 30 MINUTES", "1h": "INTERVAL 1 HOUR",
    "1d": "INTERVAL 1 DAY", "1w": "INTERVAL 7 DAYS", "1m": "INTERVAL 1 MONTH",
}

_OUT = (
    "kind STRING, symbol STRING, timestamp TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, "
    "tick_at TIMESTAMP, price DOUBLE, seq LONG"
)
_BAR = "n LONG, first_at LONG, first_seq LONG, open DOUBLE, last_at LONG, last_seq LONG, close DOUBLE, high DOUBLE, low DOUBLE"
_PACKED = f"symbol STRING, start LONG, end LONG, {_BAR}, ticks BINARY"
_TICK = np.dtype([("at", "<i8"), ("seq", "<i8"), ("price", "<f8")])
#: Bytes of rows that come to the state at a time: packed rows are long, which a count of rows doesn't bound.
_BATCH_BYTES = 4 << 20
#: A null place in the feed's order is before all others.
_NO_SEQ = -(1 << 63)


def bar_end(start: Column, timeframe: str) -> Column:
    """Where the bar that starts at ``start`` ends."""
    return start + F.expr(_WIDTHS[check_timeframe(timeframe)])


def _frame(kind: str, symbol: str, start: int, n: int, **columns) -> pd.DataFrame:
    """Rows of the output; what is not given is null. Times are microseconds."""
    none = {c: np.full(n, np.nan) for c in ("open", "high", "low", "close", "volume", "price")}
    rows = {"kind": kind, "symbol": symbol, "timestamp": pd.to_datetime(np.full(n, start), unit="us")} | none
    rows |= {"tick_at": pd.Series([pd.NaT] * n, dtype="datetime64[us]"), "seq": pd.Series([None] * n, dtype="Int64")} | columns
    return pd.DataFrame(rows, index=range(n))[["kind", "symbol", "timestamp", "open", "high", "low", "close", "volume", "tick_at", "price", "seq"]]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bar of a batch: the fold of its ticks, and the ticks themselves, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ticks = np.empty(batch.num_rows, _TICK)
        for name in _TICK.names:
            ticks[name] = batch.column(name).to_numpy()
        symbol = batch.column("symbol").dictionary_encode(null_encoding="encode").indices.to_numpy()
        start, end = batch.column("start").to_numpy(), batch.column("end").to_numpy()
        order = np.lexsort((ticks["seq"], ticks["at"], start, symbol))
        ticks, symbol, start = ticks[order], symbol[order], start[order]
        first = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1])])
        stop = np.r_[first[1:], len(ticks)]
        head, tail, price = ticks[first], ticks[stop - 1], ticks["price"]
        offsets = pa.array(np.r_[0, stop * _TICK.itemsize].astype(np.int32))
        columns = {
            "symbol": batch.column("symbol").take(pa.array(order[first])), "start": start[first], "end": end[order[first]], "n": stop - first,
            "first_at": head["at"], "first_seq": head["seq"], "open": head["price"], "last_at": tail["at"], "last_seq": tail["seq"], "close": tail["price"],
            # As everywhere, a price that is no number is above all others.
            "high": np.maximum.reduceat(price, first), "low": np.fmin.reduceat(price, first),
            "ticks": pa.Array.from_buffers(pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(ticks.tobytes())]),
        }
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns.values()], names=list(columns))


class _BarProcessor(StatefulProcessor):
    """Keeps one open bar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bar = handle, handle.getValueState("bar", _BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        symbol, start, end = key
        if end // 1000 <= timerValues.getCurrentWatermarkInMs():
            for packed in rows:
                ticks = np.frombuffer(b"".join(packed["ticks"]), _TICK)
                at, seq = pd.to_datetime(ticks["at"], unit="us"), pd.Series(ticks["seq"], dtype="Int64").where(ticks["seq"] != _NO_SEQ)
                yield _frame("late", symbol, start, len(ticks), tick_at=at.to_numpy(), price=ticks["price"], seq=seq.to_numpy())
            return
        known = self.bar.get() if self.bar.exists() else None
        if known is None:
            self.handle.registerTimer(end // 1000)
        for packed in rows:
            head = packed.iloc[np.lexsort((packed["first_seq"].to_numpy(), packed["first_at"].to_numpy()))[0]]
            tail = packed.iloc[np.lexsort((packed["last_seq"].to_numpy(), packed["last_at"].to_numpy()))[-1]]
            first, last = (int(head["first_at"]), int(head["first_seq"]), float(head["open"])), (int(tail["last_at"]), int(tail["last_seq"]), float(tail["close"]))
            own = (int(packed["n"].sum()), *first, *last, float(np.maximum.reduce(packed["high"].to_numpy())), float(np.fmin.reduce(packed["low"].to_numpy())))
            known = own if known is None else self._joined(tuple(known), own)
        self.bar.update(known)

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        first, last = min(a[1:4], b[1:4], key=lambda x: x[:2]), max(a[4:7], b[4:7], key=lambda x: x[:2])
        high = float("nan") if a[7] != a[7] or b[7] != b[7] else max(a[7], b[7])
        return (a[0] + b[0], *first, *last, high, float(np.nanmin([a[8], b[8]])) if a[8] == a[8] or b[8] == b[8] else a[8])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        symbol, start, _ = key
        if self.bar.exists():
            n, _, _, open_, _, _, close, high, low = self.bar.get()
            self.bar.clear()
            yield _frame("bar", symbol, start, 1, open=open_, high=high, low=low, close=close, volume=float(n))


def bars_and_late_ticks(
    ticks: DataFrame, timeframe: str, delay: str = "10 minutes", ts: str = "ts", price: str = "price", seq: str = "seq"
) -> DataFrame:
    """Closed bars (``kind`` bar) and ticks whose bar was closed when they came (``kind`` late: tick_at, price, seq), append mode.

    The watermark is ``delay`` behind the latest tick of the micro-batches before, over all symbols. Every tick with a time and a price
    is in a bar or late, once; bars that the watermark has not passed are open. Needs the RocksDB state store. The session's Arrow
    batches are bounded in bytes from here on.
    """
    start = bar_start(F.col(ts), timeframe)
    placed = (
        ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
        .withWatermark(ts, delay)
        # The time as a plain number: Spark would drop late rows by a column that it knows as the watermark's.
        .select(
            "symbol", F.unix_micros(start).alias("start"), F.unix_micros(bar_end(start, timeframe)).alias("end"),
            F.unix_micros(ts).alias("at"), F.col(price).cast("double").alias("price"), F.coalesce(F.col(seq).cast("long"), F.lit(_NO_SEQ)).alias("seq"),
        )
    )
    ticks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    found = placed.mapInArrow(_packed, _PACKED).groupBy("symbol", "start", "end").transformWithStateInPandas(
        statefulProcessor=_BarProcessor(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
    # Pandas has one mark for no number and no value. Here prices are never absent: what a row has none of, its kind tells.
    number = lambda c: F.coalesce(c, F.lit(float("nan")))
    prices = {c: F.when(F.col("kind") == "bar", number(c)) for c in schemas.PRICES}
    return found.withColumns(prices | {"price": F.when(F.col("kind") == "late", number("price"))})


def closed_bars(found: DataFrame, timeframe: str, provider: str) -> DataFrame:
    """The canonical bars among what ``bars_and_late_ticks`` gives."""
    told = found.where("kind = 'bar'").withColumns({"timeframe": F.lit(timeframe), "provider": F.lit(provider)})
    return schemas.conform(told, schemas.BARS)


def late_ticks(found: DataFrame) -> DataFrame:
    """The late ticks among them: (symbol, timestamp of their bar, ts, price, seq)."""
    return found.where("kind = 'late'").select("symbol", "timestamp", F.col("tick_at").alias("ts"), "price", "seq")
