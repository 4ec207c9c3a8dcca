"""Providers as Spark data sources: how a user adds a feed that no built-in format reads.

A provider names itself and implements the downloads it supports, one (symbol, time range) per call.
``read_provider`` turns requests into Spark partitions, so downloads run in tasks and are retried by
Spark. A long range is cut by year: one popular symbol is many tasks. ``stream_provider`` reads the same downloads as a stream whose
offsets are days. Rows reach Spark as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marketlake.functions.keys import PROVIDER_DEFAULTS
from marketlake.operators.resample import check_timeframe

_SCHEMAS = {
    "ohlcv": "timestamp TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, "
    "symbol STRING, timeframe STRING, provider STRING, seq BIGINT",
    "news": "headline STRING, published_at TIMESTAMP, source STRING, url STRING, symbol STRING, provider STRING",
    "fundamentals": "as_of STRING, pe_ratio DOUBLE, pb_ratio DOUBLE, revenue_growth DOUBLE, earnings_surprise DOUBLE, "
    "market_cap DOUBLE, eps DOUBLE, symbol STRING, provider STRING",
    "macro": "date TIMESTAMP, value DOUBLE, series STRING, provider STRING",
    "symbols": "symbol STRING, provider STRING",
}
#: The same types in Arrow: readers are made where no session parses schemas.
_ARROW = {"TIMESTAMP": pa.timestamp("us", "UTC"), "DOUBLE": pa.float64(), "STRING": pa.string(), "BIGINT": pa.int64()}
#: Rows of a provider that yields tuples which make an Arrow batch.
_BATCH_ROWS = 10_000


class Provider:
    """Base class. Downloads yield Arrow record batches, or tuples, of the data type's leading columns:

    bars ``(timestamp, open, high, low, close, volume)``, news ``(headline, published_at, source, url)``,
    fundamentals ``(as_of, six metrics)``, macro ``(date, value)``. ``options`` are those of the read.
    """

    name = ""
    supported_timeframes: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str] | None = None) -> None:
        self.options = options or {}

    def symbols(self) -> Iterator[str]:
        raise NotImplementedError(f"{self.name} does not list its symbols")

    def newest(self) -> date | None:
        """The last day of which the provider has everything; None: it is never behind."""
        return None

    def download_bars(self, symbol: str, timeframe: str, start: date, end: date) -> Iterator[tuple]:
        raise NotImplementedError(f"{self.name} has no bars")

    def download_news(self, symbol: str, start: date, end: date) -> Iterator[tuple]:
        raise NotImplementedError(f"{self.name} has no news")

    def download_fundamentals(self, symbol: str) -> Iterator[tuple]:
        raise NotImplementedError(f"{self.name} has no fundamentals")

    def download_macro(self, series: str, start: date, end: date) -> Iterator[tuple]:
        raise NotImplementedError(f"{self.name} has no macro series")


class _Request(InputPartition):
    def __init__(self, names: list[str], start: date, end: date, first_seq: int) -> None:
        self.names, self.start, self.end, self.first_seq = names, start, end, first_seq


#: Rows of one request are numbered inside a block of this size, so that `seq` follows the range.
_SEQ_BLOCK = 1 << 40


def _by_year(start: date, end: date) -> list[tuple[date, date]]:
    return [
        (max(start, date(y, 1, 1)), min(end, date(y, 12, 31)))
        for y in range(start.year, end.year + 1)
    ]


class _Downloads:
    """What one name and range of a request gives, as Arrow batches with the columns Spark expects."""

    def __init__(self, provider: Provider, data_type: str, timeframe: str) -> None:
        self.provider, self.data_type, self.timeframe = provider, data_type, timeframe
        columns = (c.split(" ") for c in _SCHEMAS[data_type].split(", "))
        self.schema = pa.schema([(name, _ARROW[kind]) for name, kind in columns])
        if data_type == "ohlcv" and check_timeframe(timeframe) not in provider.supported_timeframes:
            raise ValueError(f"{provider.name} has no {timeframe} bars")

    def _raw(self, name: str, start: date, end: date) -> Iterator:
        provider = self.provider
        return iter({
            "ohlcv": lambda: provider.download_bars(name, self.timeframe, start, end),
            "news": lambda: provider.download_news(name, start, end),
            "fundamentals": lambda: provider.download_fundamentals(name),
            "macro": lambda: provider.download_macro(name, start, end),
            "symbols": lambda: ((s,) for s in provider.symbols()),
        }[self.data_type]())

    def _columns(self, raw: Iterator) -> Iterator[list[pa.Array]]:
        """The downloaded columns, batch by batch."""
        kinds = [f.type for f in self.schema]
        while (first := next(raw, None)) is not None:
            if isinstance(first, pa.RecordBatch):
                yield [c.cast(kind) for c, kind in zip(first.columns, kinds)]
                continue
            rows = [first, *islice(raw, _BATCH_ROWS - 1)]
            yield [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds)]

    def batches(self, name: str, start: date, end: date, seq: int = 0) -> Iterator[pa.RecordBatch]:
        for columns in self._columns(self._raw(name, start, end)):
            n = len(columns[0])
            told = {"symbol": name, "series": name, "timeframe": self.timeframe, "provider": self.provider.name}
            for field in list(self.schema)[len(columns) :]:
                same = field.name != "seq" and pa.scalar(told[field.name], field.type)
                columns.append(pa.repeat(same, n) if same else pa.array(range(seq, seq + n), field.type))
            seq += n
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class _ProviderReader(DataSourceReader):
    def __init__(self, provider: Provider, options: dict[str, str]) -> None:
        self.data_type = options["datatype"]
        self.names = options.get("names", "").split(",")
        self.per_task = int(options.get("namespertask", "1"))
        self.start = date.fromisoformat(options.get("start", "2020-01-01"))
        self.end = date.fromisoformat(options.get("end", "2025-01-01"))
        self.downloads = _Downloads(provider, self.data_type, options.get("timeframe", "1d"))

    def _requests(self, start: date, end: date) -> list[InputPartition]:
        once = self.data_type in ("fundamentals", "symbols")
        ranges = [(start, end)] if once else _by_year(start, end)
        return [
            _Request(self.names[first : first + self.per_task], low, high, i * _SEQ_BLOCK)
            for first in range(0, len(self.names), self.per_task)
            for i, (low, high) in enumerate(ranges)
        ]

    def partitions(self) -> list[InputPartition]:
        return self._requests(self.start, self.end)

    def read(self, partition: _Request) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            yield from self.downloads.batches(name, partition.start, partition.end, partition.first_seq)


class _ProviderStream(_ProviderReader, DataSourceStreamReader):
    """Offsets are days: all up to and with that day was read. A restarted query goes on after its checkpoint's day."""

    def initialOffset(self) -> dict:
        return {"day": (self.start - timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        newest = self.downloads.provider.newest() or date.today() - timedelta(days=1)
        return {"day": max(min(newest, self.end), self.start - timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = date.fromisoformat(start["day"]) + timedelta(days=1), date.fromisoformat(end["day"])
        return self._requests(first, last) if first <= last else []


#: Providers by session: what one session registers, another doesn't see.
_registered: dict[str, dict[str, type[Provider]]] = {}


def _of_session(spark: SparkSession | None) -> dict[str, type[Provider]]:
    spark = spark or SparkSession.getActiveSession()
    return {} if spark is None else _registered.setdefault(spark._jsparkSession.sessionUUID(), {})


def register_provider(spark: SparkSession, provider: type[Provider]) -> None:
    """Make a provider readable by ``spark.read.format(provider.name)`` and ``spark.readStream``. The last one of a name wins."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return provider.name

        def schema(self) -> str:
            return _SCHEMAS[self.options["datatype"]]

        def reader(self, schema) -> DataSourceReader:
            return _ProviderReader(provider(dict(self.options)), dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _ProviderStream(provider(dict(self.options)), dict(self.options))

    spark.dataSource.register(Source)
    _of_session(spark)[provider.name] = provider


def registered_providers(spark: SparkSession | None = None) -> tuple[str, ...]:
    return tuple(_of_session(spark))


def list_providers(spark: SparkSession, health: DataFrame) -> DataFrame:
    """Every registered provider, its timeframes, and whether its last attempt succeeded (null: none seen).

    ``health`` is what :func:`marketlake.operators.catalog.provider_health` gives.
    """
    names = [(name, list(cls.supported_timeframes)) for name, cls in sorted(_of_session(spark).items())]
    known = spark.createDataFrame(names, "provider STRING, supported_timeframes ARRAY<STRING>")
    return known.join(health.select("provider", "healthy"), "provider", "left")


def provider_for(data_type: str, name: str | None = None, spark: SparkSession | None = None) -> str:
    """The named provider, or the data type's default one; an unknown one is an error."""
    if name is None:
        if data_type not in PROVIDER_DEFAULTS:
            raise ValueError(f"no default provider for data type {data_type!r}")
        name = PROVIDER_DEFAULTS[data_type]
    known = _of_session(spark)
    if name not in known:
        raise KeyError(f"provider {name!r} is not registered; one of {', '.join(known)}")
    return name


def provider_symbols(spark: SparkSession, provider: str, **options: str) -> DataFrame:
    """(symbol, provider) as the provider itself lists them; an unknown provider is an error."""
    return spark.read.format(provider_for("ohlcv", provider, spark)).options(datatype="symbols", **options).load()


def read_provider(
    spark: SparkSession,
    data_type: str,
    names: Sequence[str] | DataFrame,
    start: str,
    end: str,
    timeframe: str = "1d",
    provider: str | None = None,
    names_per_task: int = 1,
    tasks: int = 200,
    **options: str,
) -> DataFrame:
    """Raw rows of the given symbols (or series): a Spark partition per year and ``names_per_task`` names.

    Names may also be a table of any size, its first column: they are then dealt out over ``tasks`` partitions and never
    pass through the driver. ``options`` reach the provider.
    """
    name = provider_for(data_type, provider, spark)
    if isinstance(names, DataFrame):
        return _read_of_table(names, data_type, start, end, timeframe, _of_session(spark)[name], tasks, options)
    return (
        spark.read.format(name)
        .options(datatype=data_type, names=",".join(names), start=start, end=end, timeframe=timeframe, **options)
        .option("namespertask", names_per_task)
        .load()
    )


def _read_of_table(names: DataFrame, data_type: str, start: str, end: str, timeframe: str, provider: type[Provider], tasks: int, options: dict[str, str]) -> DataFrame:
    ranges = [(date.fromisoformat(start), date.fromisoformat(end))]
    ranges = ranges if data_type == "fundamentals" else _by_year(*ranges[0])
    _Downloads(provider(options), data_type, timeframe)  # an unsupported timeframe fails here already

    def download(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        downloads = _Downloads(provider(options), data_type, timeframe)
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), strict=True):
                yield from downloads.batches(name, *ranges[at], at * _SEQ_BLOCK)

    each = F.sequence(F.lit(0), F.lit(len(ranges) - 1))
    wanted = names.select(F.col(names.columns[0]).cast("string").alias("name")).where("name is not null").distinct()
    dealt = wanted.select("name", F.explode(each).alias("at")).repartition(tasks, "name", "at")
    return dealt.mapInArrow(download, _SCHEMAS[data_type])


def stream_provider(
    spark: SparkSession, data_type: str, names: Sequence[str], start: str, timeframe: str = "1d", provider: str | None = None, names_per_task: int = 1, **options: str
) -> DataFrame:
    """The provider's rows as a stream, from ``start`` on: each micro-batch has the days that became complete since the last one,
    a Spark partition per year and ``names_per_task`` names. ``end`` among the options is the last day to read."""
    told = {"datatype": data_type, "names": ",".join(names), "start": start, "end": "9999-12-30", "timeframe": timeframe} | options
    return spark.readStream.format(provider_for(data_type, provider, spark)).options(**told).option("namespertask", names_per_task).load()
