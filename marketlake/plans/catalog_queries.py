"""Registered queries on the catalog: keys, requests, registry, log, outages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.functions import iso_created_at, iso_seconds
from marketlake.operators import catalog, events
from marketlake.operators.outages import outages
from marketlake.operators.universe import symbol_universe
from marketlake.plans import views
from marketlake.plans.oracle_views import over


def _text(c: str) -> F.Column:
    return F.coalesce(c, F.lit("")).alias(c)


def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.latest_version(views.registry(spark, sf_dir))
    return rows.select("hash", "storage_uri", "data_type", _text("symbol"), _text("timeframe"), _text("series"))


def request_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).select(
        "data_type", "provider", _text("symbol"), _text("timeframe"), _text("series"), "hash"
    )


def plan_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing, past its time to live, or invalidated, and what is served."""
    registry = views.registry(spark, sf_dir)
    plan = catalog.planned(views.requests(spark, sf_dir), registry, views.as_of(), _unsound(registry))
    return plan.select("hash", "data_type", "status", F.col("due").alias("todo"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve(views.requests(spark, sf_dir), views.registry(spark, sf_dir), views.as_of())


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("hash", "data_type", _text("storage_uri"), "status")


def list_datasets_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog.list_datasets(views.registry(spark, sf_dir), data_type="ohlcv", provider="yahoo")
    rows = catalog.to_records(catalog.page(listed, limit=50, offset=20))
    return rows.select("hash", "symbol", "timeframe", "rows", "columns", "quality_passed", "created_at")


def list_datasets_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last but one fifty of the whole registry, most of which comes before."""
    registry = views.registry(spark, sf_dir)
    rows = catalog.to_records(catalog.deep_page(registry, limit=50, offset=max(0, registry.count() - 100), rows_at_once=200))
    return rows.select("hash", "data_type", "rows", "quality_passed", "created_at")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.latest_version(views.registry(spark, sf_dir))
    return rows.select("hash", "rows", "quality_passed", iso_created_at(F.col("created_at")).alias("created_at"))


def _unsound(registry: DataFrame) -> DataFrame:
    """Tombstones for every dataset of which some version failed its checks."""
    return catalog.invalidate(registry, F.lit("2024-01-30 12:00:00"), hashes=registry.where(~F.col("quality_passed")))


def invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in force after the invalidation."""
    registry = views.registry(spark, sf_dir)
    rows = catalog.latest_version(registry, _unsound(registry))
    return rows.select("hash", "data_type", iso_created_at(F.col("created_at")).alias("created_at"))


def invalidate_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets that an invalidation of one symbol ends."""
    return catalog.invalidate(views.registry(spark, sf_dir), views.as_of(), symbol="s7").select("hash")


def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets that go back to their provider when everything requested is refreshed."""
    wanted = views.requests(spark, sf_dir).drop("hash").withColumn("symbol", F.lower("symbol"))
    return catalog.refresh(views.registry(spark, sf_dir), wanted, views.as_of()).select("hash")


def freshness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.freshness_stats(views.registry(spark, sf_dir), views.as_of())


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per version, after the versions that failed their checks were removed."""
    registry = views.registry(spark, sf_dir)
    log = registry.select("hash", "created_at", "provider", "data_type", F.lit("success").alias("status"))
    kept = registry.where("quality_passed")
    return catalog.lineage(log, kept).select(
        "hash", iso_created_at(F.col("created_at")).alias("created_at"), "provider", "data_type",
        F.coalesce("rows", F.lit(-1)).alias("rows"), F.col("storage_uri").isNull().alias("orphan"),
    )


def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ingestion_summary(views.attempts(spark, sf_dir))


def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.provider_health(views.attempts(spark, sf_dir), views.as_of(), "7 days", seq="log_id")


def outage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per provider, with pauses of twelve hours."""
    runs = outages(views.attempts(spark, sf_dir), keys=["provider"], order=["log_id"], gap_seconds=43_200)
    return runs.select(
        "provider", iso_created_at(F.col("started_at")).alias("started_at"),
        iso_created_at(F.col("ended_at")).alias("ended_at"), "n_failures",
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.ticks(spark, sf_dir, "user_id").withColumn("provider", F.lit("yahoo"))
    return symbol_universe(bars, views.raw_news(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingested = events.ingested_events(views.registry(spark, sf_dir))
    served = events.served_events(_resolved(spark, sf_dir), views.as_of())
    return ingested.unionByName(served).unionByName(events.failed_events(views.attempts(spark, sf_dir)))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event", "payload", iso_created_at(F.col("published_at")).alias("published_at"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events.event_counts(events.parse_events(_events(spark, sf_dir)))
    return counts.select(iso_seconds(F.col("window_start")).alias("window_start"), "event", _text("data_type"), "n")


QUERIES = {
    "dataset_hash": dataset_hash,
    "request_manifest": request_manifest,
    "plan_ingestion": plan_ingestion,
    "resolve": resolve,
    "list_datasets_page": list_datasets_page,
    "list_datasets_deep_page": list_datasets_deep_page,
    "latest_version": latest_version,
    "invalidate": invalidate,
    "invalidate_symbol": invalidate_symbol,
    "refresh": refresh,
    "freshness_stats": freshness_stats,
    "lineage": lineage,
    "ingestion_summary": ingestion_summary,
    "provider_health": provider_health,
    "outages": outage_runs,
    "symbol_universe": universe,
    "event_payloads": event_payloads,
    "event_counts": event_counts,
}

_AS_OF = "TIMESTAMP '2024-01-31'"


def _iso(c: str) -> str:
    return (
        f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({c}, '.%f') END || '+00:00' AS {c.split('.')[-1]}"
    )


_TTL = (
    "CASE WHEN data_type = 'ohlcv' AND timeframe NOT IN ('1d', '1w', '1m') THEN 3600 WHEN data_type = 'ohlcv' THEN 86400 "
    "WHEN data_type = 'news' THEN 21600 WHEN data_type = 'fundamentals' THEN 86400 ELSE 259200 END"
)
_AGE = f"(CAST(floor(epoch({_AS_OF})) AS BIGINT) - CAST(floor(epoch(created_at)) AS BIGINT))"
_JSON = "coalesce('\"' || {c} || '\"', 'null')"


def _j(c: str) -> str:
    return _JSON.format(c=c)


_EVENTS = f"""
    resolved AS (
        SELECT r.hash, r.symbol FROM requests r JOIN latest l ON l.hash = r.hash
        WHERE {_AGE.replace('created_at', 'l.created_at')} < {_TTL.replace('data_type', 'r.data_type').replace('timeframe', 'r.timeframe')}),
    log AS (
        SELECT 'DatasetIngested' AS event, created_at AS published_at, data_type,
               '{{"data_type":"' || data_type || '","symbol":' || {_j('symbol')} || ',"timeframe":' || {_j('timeframe')}
               || ',"storage_uri":"' || storage_uri || '","hash":"' || hash || '","rows":' || rows || '}}' AS payload
        FROM stored_registry
        UNION ALL
        SELECT 'DatasetServedFromCache', {_AS_OF}, '', '{{"hash":"' || hash || '","symbol":' || {_j('symbol')} || '}}' FROM resolved
        UNION ALL
        SELECT 'IngestionFailed', completed_at, data_type,
               '{{"data_type":"' || data_type || '","symbol":"' || symbol || '","error":"' || error || '"}}'
        FROM attempts WHERE status = 'failed')
"""

ORACLES = {
    "dataset_hash": over(["latest"], """
        SELECT hash, storage_uri, data_type, coalesce(symbol, '') AS symbol, coalesce(timeframe, '') AS timeframe,
               coalesce(series, '') AS series
        FROM latest"""),
    "request_manifest": over(["requests"], """
        SELECT data_type, provider, coalesce(symbol, '') AS symbol, coalesce(timeframe, '') AS timeframe,
               coalesce(series, '') AS series, hash
        FROM requests"""),
    "plan_ingestion": over(["requests", "latest"], f"""
        , held AS (
            SELECT * FROM latest
            WHERE hash NOT IN (SELECT hash FROM stored_registry WHERE NOT quality_passed) OR created_at > TIMESTAMP '2024-01-30 12:00:00')
        SELECT *, status <> 'fresh' AS todo FROM (
            SELECT r.hash, r.data_type,
                   CASE WHEN created_at IS NULL THEN 'missing'
                        WHEN {_AGE} < {_TTL.replace('data_type', 'r.data_type').replace('timeframe', 'r.timeframe')} THEN 'fresh'
                        ELSE 'stale' END AS status
            FROM requests r LEFT JOIN held l ON l.hash = r.hash)"""),
    "invalidate_symbol": over(["stored_registry"], """
        SELECT DISTINCT hash FROM stored_registry WHERE symbol = 'S7' OR storage_uri LIKE '%/S7/%'"""),
    "refresh": over(["requests", "stored_registry"], """
        SELECT DISTINCT hash FROM stored_registry WHERE hash IN (SELECT hash FROM requests)"""),
    "resolve": over(["requests", "latest"], f"""
        SELECT r.hash, r.data_type, coalesce(storage_uri, '') AS storage_uri,
               CASE WHEN created_at IS NULL THEN 'missing'
                    WHEN {_AGE} < {_TTL.replace('data_type', 'r.data_type').replace('timeframe', 'r.timeframe')} THEN 'fresh'
                    ELSE 'stale' END AS status
        FROM requests r LEFT JOIN latest l ON l.hash = r.hash"""),
    "list_datasets_page": over(["stored_registry"], f"""
        SELECT hash, symbol, timeframe, rows, columns, quality_passed, {_iso('created_at')}
        FROM (SELECT * FROM stored_registry WHERE data_type = 'ohlcv' AND provider = 'yahoo'
              ORDER BY created_at DESC, hash LIMIT 50 OFFSET 20)"""),
    "list_datasets_deep_page": over(["stored_registry"], f"""
        SELECT hash, data_type, rows, quality_passed, {_iso('created_at')}
        FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, hash) AS place, count(*) OVER () AS n FROM stored_registry)
        WHERE place > n - 100 AND place <= n - 50"""),
    "latest_version": over(["latest"], f"SELECT hash, rows, quality_passed, {_iso('created_at')} FROM latest"),
    "invalidate": over(["latest"], f"""
        SELECT hash, data_type, {_iso('created_at')} FROM latest
        WHERE hash NOT IN (SELECT hash FROM stored_registry WHERE NOT quality_passed)
           OR created_at > TIMESTAMP '2024-01-30 12:00:00'"""),
    "freshness_stats": over(["latest"], f"""
        SELECT data_type, count(*) FILTER (WHERE {_AGE} < {_TTL}) AS n_fresh, count(*) FILTER (WHERE {_AGE} >= {_TTL}) AS n_stale
        FROM latest GROUP BY data_type"""),
    # A version is one row of the registry, so its log row needs no join to find it: one pass over each table.
    "lineage": over(["registry"], f"""
        SELECT hash, {_iso('created_at')}, provider, data_type, CASE WHEN quality_passed THEN rows ELSE -1 END AS rows,
               NOT quality_passed AS orphan
        FROM registry"""),
    "ingestion_summary": over(["attempts"], """
        SELECT coalesce(data_type, 'all') AS data_type, coalesce(status, 'all') AS status, count(*) AS n
        FROM attempts GROUP BY ROLLUP (data_type, status)"""),
    "provider_health": over(["attempts"], f"""
        SELECT provider, count(*) AS n_attempts, count(*) FILTER (WHERE status = 'failed') AS n_failed,
               last(status = 'success' ORDER BY completed_at, log_id) AS healthy
        FROM attempts WHERE completed_at > {_AS_OF} - INTERVAL 7 DAY AND completed_at <= {_AS_OF} GROUP BY provider"""),
    "outages": over(["attempts"], f"""
        , ordered AS (
            SELECT *, lag(status) OVER w AS before, lag(completed_at) OVER w AS previous
            FROM attempts WINDOW w AS (PARTITION BY provider ORDER BY completed_at, log_id)),
        islands AS (
            SELECT *, sum(CASE WHEN before = 'failed' AND status = 'failed' AND completed_at - previous <= INTERVAL 12 HOUR THEN 0 ELSE 1 END)
                      OVER (PARTITION BY provider ORDER BY completed_at, log_id ROWS UNBOUNDED PRECEDING) AS island
            FROM ordered),
        runs AS (
            SELECT provider, island, min(completed_at) AS started_at, max(completed_at) AS ended_at, count(*) AS n_failures
            FROM islands WHERE status = 'failed' GROUP BY provider, island HAVING count(*) >= 5)
        SELECT provider, {_iso('started_at')}, {_iso('ended_at')}, n_failures FROM runs"""),
    "symbol_universe": """
        SELECT DISTINCT 'yahoo' AS provider, 'S' || user_id AS symbol FROM events
        UNION SELECT DISTINCT 'news', upper(lang) FROM documents""",
    "event_payloads": over(["requests", "latest", "attempts"], f"""
        , {_EVENTS} SELECT event, payload, {_iso('published_at')} FROM log"""),
    "event_counts": over(["requests", "latest", "attempts"], f"""
        , {_EVENTS}
        SELECT strftime(date_trunc('day', published_at), '%Y-%m-%dT%H:%M:%S') AS window_start, event, data_type, count(*) AS n
        FROM log GROUP BY 1, 2, 3"""),
}
