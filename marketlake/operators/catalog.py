"""The dataset catalog: registry, ingestion log, invalidation, and the questions asked of them.

A dataset is identified by its request hash; a version of it by (hash, created_at). Both tables are
append-only.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketlake import schemas
from marketlake.functions import count_if, dataset_hash, default_provider, iso_created_at, storage_uri, ttl_seconds
from marketlake.operators.resample import TIMEFRAMES, arrival_order

# What a pre-warm run asks for.
DEFAULT_SYMBOLS = (
    "AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "NVDA", "META", "BRK-B", "JPM", "V", "SPY", "QQQ", "IWM", "GLD", "TLT",
)
DEFAULT_TIMEFRAMES = ("1d",)
DEFAULT_MACRO_SERIES = ("CPI", "FED_FUNDS_RATE", "GDP_GROWTH", "UNEMPLOYMENT")

# Bounds of a listing page.
MAX_PAGE = 500
DEFAULT_PAGE = 50

REQUEST_COLUMNS = ("data_type", "provider", "symbol", "timeframe", "series", "start", "end")


# Requests -------------------------------------------------------------------------------------


def with_request_hash(requests: DataFrame) -> DataFrame:
    """Complete requests (upper-case names, default provider) and add their ``hash``."""
    provider = F.col("provider") if "provider" in requests.columns else F.lit(None).cast("string")
    full = requests.withColumns(
        {
            c: F.lit(None).cast("string")
            for c in REQUEST_COLUMNS
            if c not in requests.columns and c != "provider"
        }
    ).withColumns({"provider": F.coalesce(provider, default_provider(F.col("data_type")))})
    full = full.withColumns({"symbol": F.upper("symbol"), "series": F.upper("series")})
    key = dataset_hash(*(F.col(c) for c in ("data_type", "provider", "symbol", "timeframe", "start", "end", "series")))
    return full.withColumn("hash", key)


def request_manifest(
    symbols: DataFrame,
    start: str,
    end: str,
    timeframes: Sequence[str] = DEFAULT_TIMEFRAMES,
    series: Sequence[str] = DEFAULT_MACRO_SERIES,
    news: bool = True,
    macro: bool = True,
) -> DataFrame:
    """Requests for bars (symbol and timeframe), news (symbol) and macro (series).

    The timeframes are a short literal list, exploded per symbol: no join.
    """
    spark = symbols.sparkSession
    wanted = symbols.select(F.upper("symbol").alias("symbol"))
    manifest = wanted.select(
        F.lit("ohlcv").alias("data_type"),
        "symbol",
        F.explode(F.array(*(F.lit(t) for t in timeframes))).alias("timeframe"),
    )
    if news:
        manifest = manifest.unionByName(
            wanted.select(F.lit("news").alias("data_type"), "symbol"), allowMissingColumns=True
        )
    if macro:
        names = spark.createDataFrame([("macro", s.upper()) for s in series], "data_type STRING, series STRING")
        manifest = manifest.unionByName(names, allowMissingColumns=True)
    return with_request_hash(manifest.withColumns({"start": F.lit(start), "end": F.lit(end)}))


def split_supported(
    requests: DataFrame, series: Sequence[str] = DEFAULT_MACRO_SERIES
) -> tuple[DataFrame, DataFrame]:
    """(requests that can be served, the others): known data types, timeframes and series."""
    known = (
        F.when(F.col("data_type") == "ohlcv", F.col("timeframe").isin(*TIMEFRAMES))
        .when(F.col("data_type") == "macro", F.upper("series").isin(*series))
        .otherwise(F.col("data_type").isin("news", "fundamentals"))
    )
    ok = F.coalesce(known, F.lit(False))
    return requests.where(ok), requests.where(~ok)


def resolve(requests: DataFrame, registry: DataFrame, as_of: Column, invalidated: DataFrame | None = None) -> DataFrame:
    """Where each request is stored, with ``status`` fresh, stale or missing at ``as_of``."""
    current = latest_version(registry, invalidated).select("hash", "storage_uri", "created_at")
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds("created_at")
    ttl = ttl_seconds(F.col("data_type"), F.col("timeframe"))
    status = F.when(F.col("created_at").isNull(), "missing").when(age < ttl, "fresh").otherwise("stale")
    return requests.join(current, "hash", "left").withColumn("status", status)


def planned(requests: DataFrame, registry: DataFrame, as_of: Column, invalidated: DataFrame | None = None) -> DataFrame:
    """Every request as ``resolve`` gives it, and ``due``: is it to be ingested at ``as_of`` (missing, invalidated or past its
    time to live)? One frame, so that looking at both sides evaluates it once."""
    return resolve(requests, registry, as_of, invalidated).withColumn("due", F.col("status") != "fresh")


def plan_ingestion(
    requests: DataFrame, registry: DataFrame, as_of: Column, invalidated: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(requests to ingest at ``as_of``, requests that are served), the two sides of ``planned``."""
    plan = planned(requests, registry, as_of, invalidated)
    return plan.where("due").drop("due"), plan.where("not due").drop("due")


# Registry -------------------------------------------------------------------------------------


def register_datasets(
    canonical: DataFrame,
    data_type: str,
    created_at: Column,
    root: str,
    start: str | None = None,
    end: str | None = None,
    quality: DataFrame | None = None,
    location: Column | None = None,
) -> DataFrame:
    """One registry row per series of a canonical table, in one grouped count.

    ``start`` and ``end`` are those of the request; ``quality`` is a summary per series; ``location``
    is where the series is stored, by default the storage key of its request.
    """
    keys = schemas.SERIES_KEYS[data_type]
    rows = canonical.groupBy(*keys).agg(F.count("*").alias("rows"))
    if quality is not None:
        rows = rows.join(quality.select(*keys, "quality_passed", "quality_issues"), list(keys), "left")
    absent = [c for c in ("symbol", "timeframe", "series") if c not in keys]
    text = {c: F.lit(None).cast("string") for c in absent}
    text |= {"start_date": F.lit(start).cast("string"), "end_date": F.lit(end).cast("string"), "data_type": F.lit(data_type)}
    rows = rows.withColumns(text)
    key = dataset_hash(*(F.col(c) for c in ("data_type", "provider", "symbol", "timeframe", "start_date", "end_date", "series")))
    # Without a request range the folder is dated by the day of ingestion.
    day = F.coalesce("start_date", F.date_format(created_at, "yyyy-MM-dd"))
    rows = rows.withColumns({"hash": key, "created_at": created_at.cast("timestamp"), "columns": F.lit(len(canonical.columns))})
    passed = F.coalesce("quality_passed", F.lit(True)) if quality is not None else F.lit(True)
    issues = F.when(F.size("quality_issues") > 0, F.col("quality_issues")) if quality is not None else F.lit(None)
    if location is None:
        names = (F.col(c) for c in ("data_type", "symbol", "timeframe", "series"))
        location = storage_uri(root, *names, day, F.col("hash"))
    rows = rows.withColumns({"storage_uri": location, "quality_passed": passed, "quality_issues": issues})
    return schemas.conform(rows, schemas.REGISTRY)


def list_datasets(
    registry: DataFrame,
    data_type: str | None = None,
    provider: str | None = None,
    symbol: str | None = None,
    hash_: str | None = None,
) -> DataFrame:
    """Registry rows that meet all given filters."""
    wanted = {"data_type": data_type, "provider": provider, "symbol": symbol and symbol.upper(), "hash": hash_}
    rows = registry
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def page(registry: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """A newest-first page: a top-k of ``offset + limit`` rows, never a full sort."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset not negative")
    newest = registry.orderBy(F.desc("created_at"), "hash")
    return newest.limit(offset + limit).offset(offset) if offset else newest.limit(limit)


#: Characters of the sort key that one pass of ``deep_page`` tells apart, and rows that its last step may skip.
_STEP, ROWS_AT_ONCE = 3, 100_000


def deep_page(registry: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """The page that ``page`` gives, at any offset: no task holds more than ``rows_at_once`` + ``limit`` rows.

    Newest first and then by hash, rows have one text as sort key. Counts per next characters of it, at most some thousands a pass, find
    the part of the registry in which the page begins; what comes before that is counted, not sorted. Where more rows than
    that share one whole key, they are equal in order, and as many are skipped.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset not negative")
    newest = F.lit(2**63 - 1) - F.unix_micros("created_at")
    at = F.when(F.col("created_at").isNotNull(), F.lower(F.lpad(F.hex(newest), 16, "0"))).otherwise("~")
    keyed = registry.withColumn("_key", F.concat(at, F.coalesce("hash", F.lit(""))))
    low, high, longest, n = keyed.agg(F.min("_key"), F.max("_key"), F.max(F.length("_key")), F.count("*")).first()
    if offset >= n:
        return registry.limit(0)
    prefix, skip = os.path.commonprefix([low, high]), offset
    while n > rows_at_once and len(prefix) < longest:
        part = F.substring("_key", len(prefix) + 1, _STEP).alias("part")
        counts = keyed.where(F.col("_key").startswith(prefix)).groupBy(part).agg(F.count("*").alias("n"))
        for row in sorted(counts.collect()):
            if skip < row.n:
                break
            skip -= row.n
        if not row.part:
            break
        prefix, n = prefix + row.part, row.n
    rest = keyed.where(F.col("_key") >= prefix).orderBy("_key").drop("_key")
    return rest.limit(skip + limit).offset(skip) if skip else rest.limit(limit)


def to_records(registry: DataFrame) -> DataFrame:
    """Registry rows in output form: ``created_at`` as ISO text."""
    return registry.withColumn("created_at", iso_created_at(F.col("created_at")))


def versions(registry: DataFrame, hash_: str) -> DataFrame:
    """All versions of one dataset, newest first."""
    return registry.where(F.col("hash") == hash_).orderBy(F.desc("created_at"))


def latest_version(registry: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """The newest version per hash that was not invalidated after it was made."""
    # A ranking of one row per hash: map tasks cut to that before the exchange.
    order = Window.partitionBy("hash").orderBy(F.desc("created_at"), F.desc("storage_uri"))
    rows = registry.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    if invalidated is None:
        return rows
    ends = invalidated.groupBy("hash").agg(F.max("invalidated_at").alias("invalidated_at"))
    alive = F.col("invalidated_at").isNull() | (F.col("created_at") > F.col("invalidated_at"))
    return rows.join(ends, "hash", "left").where(alive).select(*registry.columns)


def tombstones(datasets: DataFrame, at: Column) -> DataFrame:
    """Tombstones for all datasets of which the given registry rows hold a version."""
    return datasets.select("hash").distinct().withColumn("invalidated_at", at.cast("timestamp"))


def invalidate(
    registry: DataFrame, at: Column, hashes: DataFrame | None = None, symbol: str | None = None
) -> DataFrame:
    """Tombstones for the given hashes, or for every dataset of a symbol."""
    if (hashes is None) == (symbol is None):
        raise ValueError("give either hashes or a symbol")
    if hashes is not None:
        hit = registry.join(hashes.select("hash").distinct(), "hash", "left_semi")
    else:
        name = symbol.upper()
        hit = registry.where((F.col("symbol") == name) | F.col("storage_uri").contains(f"/{name}/"))
    return tombstones(hit, at)


def refresh(registry: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Tombstones that make the given requests go back to their provider."""
    return invalidate(registry, at, hashes=with_request_hash(requests))


def freshness_stats(registry: DataFrame, as_of: Column, invalidated: DataFrame | None = None) -> DataFrame:
    """Fresh and stale datasets per data type at ``as_of``."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds("created_at")
    fresh = age < ttl_seconds(F.col("data_type"), F.col("timeframe"))
    return (
        latest_version(registry, invalidated)
        .groupBy("data_type")
        .agg(count_if(fresh).alias("n_fresh"), count_if(~fresh).alias("n_stale"))
    )


# Ingestion log --------------------------------------------------------------------------------


def ingestion_log(
    data_type: str,
    raw_counts: DataFrame,
    registered: DataFrame,
    started_at: Column,
    completed_at: Column,
    failures: DataFrame | None = None,
    rejects: DataFrame | None = None,
) -> DataFrame:
    """One log row per series: success where a dataset was registered, failed where rows came in vain.

    ``raw_counts`` is (series…, rows_fetched); ``failures`` is (series…, error) for feeds that raised; ``rejects`` is (series…,
    reason) of records that could not be read: they are the error of a series that has nothing else, and an issue of others.
    """
    keys = list(schemas.SERIES_KEYS[data_type])
    done = registered.select(
        *keys, "hash", "created_at", F.col("rows").alias("rows_after_quality"), F.col("quality_issues").alias("issues")
    )
    log = raw_counts.join(done, keys, "full_outer")
    if failures is not None:
        log = log.join(failures.select(*keys, "error"), keys, "full_outer")
    else:
        log = log.withColumn("error", F.lit(None).cast("string"))
    if rejects is not None:
        counted = rejects.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
        said = F.array_sort(F.collect_list(F.concat(F.lit("rejected: "), F.col("n").cast("string"), F.lit(" x "), F.col("reason"))))
        # As many texts as there are reasons.
        log = log.join(counted.groupBy(*keys).agg(said.alias("_rejected")), keys, "full_outer")
        issues = F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.coalesce("_rejected", F.array().cast("array<string>")))
        alone = F.when(F.col("hash").isNull() & F.col("rows_fetched").isNull(), F.array_join("_rejected", "; "))
        log = log.withColumns({"issues": F.when(F.size(issues) > 0, issues), "error": F.coalesce("error", alone)})
        log = log.withColumn("rows_fetched", F.coalesce("rows_fetched", F.lit(0)))
    ok = F.col("hash").isNotNull() & F.col("error").isNull()
    log = log.withColumns(
        {
            "data_type": F.lit(data_type),
            "status": F.when(ok, "success").otherwise("failed"),
            "error": F.when(~ok, F.coalesce("error", F.lit("no usable rows"))),
            "started_at": started_at,
            "completed_at": completed_at,
        }
    )
    if "symbol" not in keys:
        log = log.withColumn("symbol", F.lit(None).cast("string"))
    return schemas.conform(log, schemas.INGESTION_LOG)


def lineage(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Every log row with its dataset version; attempts without one, or whose one is gone, keep nulls."""
    of_dataset = registry.select("hash", "created_at", "storage_uri", "rows", "quality_passed")
    return log.join(of_dataset, ["hash", "created_at"], "left")


def ingestion_summary(log: DataFrame) -> DataFrame:
    """Attempts per data type and status, with subtotals (``all``)."""
    total = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c)).alias(c)
    counted = log.rollup("data_type", "status").agg(
        F.count("*").alias("n"), total("data_type").alias("d"), total("status").alias("s")
    )
    return counted.select(F.col("d").alias("data_type"), F.col("s").alias("status"), "n")


def provider_health(log: DataFrame, as_of: Column, window: str = "1 day", seq: str | None = None) -> DataFrame:
    """Per provider: attempts and failures in the window before ``as_of``, and whether the last succeeded.

    ``seq`` names a number that orders attempts of one moment.
    """
    since = as_of.cast("timestamp") - F.expr(f"INTERVAL {window}")
    recent = log.where((F.col("completed_at") > since) & (F.col("completed_at") <= as_of.cast("timestamp")))
    return recent.groupBy("provider").agg(
        F.count("*").alias("n_attempts"),
        count_if(F.col("status") == "failed").alias("n_failed"),
        F.max_by(F.col("status") == "success", arrival_order(F.col("completed_at"), seq)).alias("healthy"),
    )
