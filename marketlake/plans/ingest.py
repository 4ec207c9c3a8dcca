"""The ingestion run: raw feed to stored, checked, registered, logged and announced datasets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlake import schemas
from marketlake.operators import events, quality
from marketlake.operators.catalog import ingestion_log, register_datasets
from marketlake.operators.day_sets import day_sets
from marketlake.operators.normalize import (
    normalize_bars,
    normalize_fundamentals,
    normalize_macro,
    normalize_news,
)
from marketlake.sinks.store import commit_runs, run_path, stored_folder, write_canonical, write_catalog
from marketlake.sources.lake import read_canonical, read_catalog


# Failed fundamentals and macro feeds are logged but not announced.
_ANNOUNCED_FAILURES = ("ohlcv", "news")


@dataclass(frozen=True)
class Request:
    """What a run ingests. ``now`` is one moment: it dates the rows and the registry entries alike."""

    data_type: str
    root: str
    run: str
    now: datetime
    start: str | None = None
    end: str | None = None
    layout: str = "symbol"
    #: Keep the days that each version covers, so that coverage over many runs needs no bars.
    coverage: bool = False


def normalize(raw: DataFrame, data_type: str, now: Column) -> DataFrame:
    """A multi-series feed, which carries its series columns, to its canonical table."""
    if data_type == "fundamentals":
        # Whoever asks for a dataset names its symbol in upper case; the normalizer itself leaves it alone.
        return normalize_fundamentals(raw.withColumn("symbol", F.upper("symbol")), now)
    return {"ohlcv": normalize_bars, "news": normalize_news, "macro": normalize_macro}[data_type](raw)


def quality_of(stored: DataFrame, data_type: str, now: Column, calendar: DataFrame | None) -> DataFrame | None:
    """Quality per series, for the data types that are checked (bars and news)."""
    keys = schemas.SERIES_KEYS[data_type]
    if data_type == "ohlcv":
        return quality.summarize(quality.check_bars(stored, calendar), keys)
    if data_type == "news":
        return quality.summarize(quality.check_news(stored, now), keys)
    return None


def ingest(raw: DataFrame, request: Request, calendar: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Run one request and return its registry rows, as stored. A run that fails is logged, then raised.

    ``rejects`` are the feed's records that could not be read, as the ``rejected_…`` twins of the parsers give them, with the
    series they belong to: they are stored with their reasons, and the log names them.

    The raw rows are landed first, as the run's raw zone: a paid or rate-limited feed is read once, whatever is retried. The
    canonical rows are written from there, and checks read the stored run: a lost executor costs a scan, not the run.
    """
    try:
        return _ingest(raw, request, calendar, rejects)
    except Exception as error:
        _record_failure(raw.sparkSession, request, str(error))
        raise


def land(raw: DataFrame, r: Request) -> DataFrame:
    """The raw rows as they came, stored under the run and read back."""
    path = run_path(r.root, f"raw_{r.data_type}", r.run)
    raw = raw.withColumns({c: F.col(c).cast("string") for c, kind in raw.dtypes if kind == "void"})
    raw.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return raw.sparkSession.read.schema(raw.schema).parquet(path)


def _ingest(raw: DataFrame, request: Request, calendar: DataFrame | None, rejects: DataFrame | None) -> DataFrame:
    r, spark, now = request, raw.sparkSession, F.lit(request.now)
    keys = schemas.SERIES_KEYS[r.data_type]
    raw = land(raw, r)
    write_canonical(normalize(raw, r.data_type, now), r.data_type, r.root, r.run, now, r.start, r.end, r.layout)

    stored = read_canonical(spark, r.root, r.data_type, run=r.run)
    canonical = stored.select(*schemas.CANONICAL[r.data_type].fieldNames())
    summary = quality_of(canonical, r.data_type, now, calendar)
    location = stored_folder(r.data_type, r.root, r.run, r.layout)
    registered = register_datasets(canonical, r.data_type, now, r.root, r.start, r.end, summary, location)
    part = f"{r.data_type}-{r.run}"
    # From here on readers see the run, whole.
    commit_runs(spark, r.data_type, r.root, r.run, r.now, r.run)
    write_catalog(registered, "registry", r.root, part)

    registered = read_catalog(spark, r.root, "registry", part)
    if r.coverage:
        sets = day_sets(canonical, keys, schemas.TIME_COLUMN[r.data_type])
        of_version = registered.select("hash", "created_at", "data_type", *(c for c in ("symbol", "timeframe", "series") if c not in keys), *keys)
        write_catalog(sets.join(of_version, list(keys)), "coverage", r.root, part)
    upper = [F.upper(k).alias(k) if k in ("series", "symbol") else F.col(k) for k in keys]
    fetched = raw.groupBy(*upper).agg(F.count("*").alias("rows_fetched"))
    if rejects is not None:
        known = {"data_type": F.lit(r.data_type), "rejected_at": now}
        absent = [c for c in ("provider", "symbol", "series") if c not in rejects.columns]
        full = rejects.withColumns(known | {c: F.lit(None).cast("string") for c in absent})
        write_catalog(full.withColumns({c: F.upper(c) for c in ("symbol", "series")}), "rejects", r.root, part)
        rejects = read_catalog(spark, r.root, "rejects", part)
    log = ingestion_log(r.data_type, fetched, registered, now, now, rejects=rejects)
    write_catalog(log, "ingestion_log", r.root, part)

    log = read_catalog(spark, r.root, "ingestion_log", part)
    announced = events.ingested_events(registered)
    if r.data_type in _ANNOUNCED_FAILURES:
        announced = announced.unionByName(events.failed_events(log))
    write_catalog(announced, "events", r.root, part)
    return registered


def _record_failure(spark: SparkSession, r: Request, error: str) -> None:
    """One log row, and event, for a run that raised; its series are not known."""
    part = f"{r.data_type}-{r.run}-failed"
    columns = {"data_type": r.data_type, "status": "failed", "error": error}
    log = spark.range(1).select(
        *(F.lit(columns.get(f.name)).cast(f.dataType).alias(f.name) for f in schemas.INGESTION_LOG if not f.name.endswith("ed_at")),
        *(F.lit(r.now).alias(c) for c in ("started_at", "completed_at")),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    write_catalog(log, "ingestion_log", r.root, part)
    if r.data_type in _ANNOUNCED_FAILURES:
        write_catalog(events.failed_events(log), "events", r.root, part)
