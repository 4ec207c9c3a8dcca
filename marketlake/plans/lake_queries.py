"""Registered queries that write: the ingestion run and the streams, read back from what they stored.

They write below the cluster's shared folder, each call to a path of its own.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.functions import iso_created_at, iso_seconds
from marketlake.operators import day_sets, events
from marketlake.operators.calendar import exchange_calendar
from marketlake.operators.catalog import invalidate, with_request_hash
from marketlake.operators.reads import get_bars
from marketlake.plans import views
from marketlake.plans.ingest import Request, ingest
from marketlake.plans.oracle_views import over
from marketlake.schemas import PRICES
from marketlake.session import shared_folder
from marketlake.sinks.store import compact, expire, write_catalog
from marketlake.sources.lake import current_rows, lookup_hashes, read_canonical, read_catalog, reconcile, stored_coverage, stored_files
from marketlake.streaming.bars import first_by_seq, tumbling_bars
from marketlake.streaming.events import running_counts
from marketlake.streaming.ingest import ingest_stream

_SHOWN = ("symbol", "timestamp", *PRICES, "volume")


def _trading_days(spark: SparkSession) -> DataFrame:
    """The exchange days, without holidays, that the gap check of an ingestion run expects."""
    return exchange_calendar(spark, views.START, views.END).where("exchange = 'XNYS'").select("day")


def _ingested(spark: SparkSession, sf_dir: str, data_type: str) -> tuple[str, DataFrame]:
    """Ingest the raw view of a data type; its folder and its registry rows."""
    root = shared_folder(spark)
    raw = views.raw_bars(spark, sf_dir) if data_type == "ohlcv" else views.raw_news(spark, sf_dir)
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    request = Request(data_type, root, "r1", now, views.START, views.END)
    return root, ingest(raw, request, _trading_days(spark))


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the raw bars, then read the versions in force by range, pruned to their folders."""
    root, registry = _ingested(spark, sf_dir, "ohlcv")
    stored = read_canonical(spark, root, "ohlcv", start="2024-01-05", end="2024-01-20")
    return get_bars(current_rows(stored, registry), None, "1h", "2024-01-05", "2024-01-20").select(*_SHOWN)


def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds after three overlapping requests, told apart by their volume, of which the last was invalidated."""
    root, raw = shared_folder(spark), views.raw_bars(spark, sf_dir)
    calendar = _trading_days(spark)
    for run, start, end, volume in (("r1", "2024-01-01", "2024-01-19", "1"), ("r2", "2024-01-10", "2024-01-31", "2"), ("r3", "2024-01-25", "2024-01-31", "3")):
        part = raw.where(F.substring("Date", 1, 10).between(start, end)).withColumn("Volume", F.lit(volume))
        ingest(part, Request("ohlcv", root, run, datetime(2024, 2, int(volume), tzinfo=timezone.utc), start, end), calendar)
    registry = read_catalog(spark, root, "registry")
    gone = invalidate(registry, F.lit("2024-02-04"), hashes=registry.where("start_date = '2024-01-25'"))
    rows = current_rows(read_canonical(spark, root, "ohlcv"), registry, gone)
    return rows.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(*_SHOWN)


def compacted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of three overlapping requests, told apart by their volume, of which the first two were compacted before the
    third came: with the old runs' folders there, after they went, and as of the moment before the third. And folders that nobody
    registered, and versions without files: none."""
    root, raw = shared_folder(spark), views.raw_bars(spark, sf_dir)
    calendar = _trading_days(spark)
    day = lambda n: datetime(2024, 2, n, tzinfo=timezone.utc)

    def request(run: str, start: str, volume: str, at: datetime, end: str = "2024-01-31") -> None:
        part = raw.where(F.substring("Date", 1, 10).between(start, end)).withColumn("Volume", F.lit(volume))
        ingest(part, Request("ohlcv", root, run, at, start, end), calendar)

    def held(phase: str, as_of: datetime | None = None) -> DataFrame:
        registry = read_catalog(spark, root, "registry", as_of=as_of)
        rows = current_rows(read_canonical(spark, root, "ohlcv", as_of=as_of), registry)
        shown = rows.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(F.lit(phase).alias("phase"), *_SHOWN)
        # Written here: what the next phase deletes is read before.
        path = f"{root}/held/{phase}"
        shown.write.mode("overwrite").parquet(path)
        return spark.read.schema(shown.schema).parquet(path)

    request("r1", "2024-01-01", "1", day(1), "2024-01-19")
    request("r2", "2024-01-10", "2", day(2))
    compact(spark, "ohlcv", root, "c1", at=day(3))
    request("r3", "2024-01-25", "3", day(4))
    out = held("compacted").unionByName(held("as of", day(3)))
    expire(spark, "ohlcv", root, day(3))
    out = out.unionByName(held("expired"))
    lost, unknown = reconcile(read_catalog(spark, root, "registry"), stored_files(spark, root, "ohlcv"))
    odd = lost.select("symbol").unionByName(unknown.select(F.col("place").alias("symbol"))).withColumn("phase", F.lit("not reconciled"))
    return out.unionByName(odd, allowMissingColumns=True)


def merged_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bars of three runs cover, and the trading days they lack, from the day sets that the runs stored: no bar is read."""
    root, raw = shared_folder(spark), views.raw_bars(spark, sf_dir)
    # Every seventh day is dropped, another one for each symbol; each run has every third of the others.
    day = F.dayofmonth(F.substring("Date", 1, 10).cast("date"))
    raw = raw.where((F.substring("symbol", 2, 9).cast("int") + day) % 7 != 0)
    calendar, keys = _trading_days(spark), ["symbol", "timeframe", "provider"]
    for k in range(3):
        at = datetime(2024, 2, 1 + k, tzinfo=timezone.utc)
        ingest(raw.where(day % 3 == k), Request("ohlcv", root, f"r{k}", at, f"2024-01-0{k + 1}", views.END, coverage=True))
    sets = stored_coverage(spark, root, "ohlcv")
    days = day_sets.covered(sets, keys).select("symbol", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")), "n_days")
    lacking = day_sets.missing_days(sets, calendar, keys).groupBy("symbol").agg(F.count("*").alias("n_missing"), F.min("day").cast("string").alias("first_missing"))
    return days.join(lacking, "symbol", "left").withColumns({"n_missing": F.coalesce("n_missing", F.lit(0)), "first_missing": F.coalesce("first_missing", F.lit(""))})


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of the datasets of five symbols, out of a stored registry."""
    root = shared_folder(spark)
    write_catalog(views.registry(spark, sf_dir), "registry", root, "r1")
    names = spark.createDataFrame([(f"S{n}", t) for n in (1, 2, 3, 5, 8) for t in ("1d", "1h")], "symbol STRING, timeframe STRING")
    wanted = with_request_hash(names.withColumns({"data_type": F.lit("ohlcv"), "start": F.lit(views.START), "end": F.lit(views.END)}))
    rows = lookup_hashes(spark, root, [r.hash for r in wanted.select("hash").collect()])  # of ten requests
    return rows.select("hash", "symbol", "timeframe", "rows", iso_created_at(F.col("created_at")).alias("created_at"))


#: Rows of a file of a stream's input, about.
FILE_ROWS = 250_000


def files_of(sizes: list[int]) -> int:
    """How many files each of a stream's micro-batches is written as, given their rows: as many for all, none of them empty."""
    return max(1, min(-(-max(sizes, default=0) // FILE_ROWS), min(sizes, default=0) // 1000))


def ingest_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds after a stream of micro-batches, each all rows of half of the symbols, that repeats all it sent before."""
    root = shared_folder(spark)
    raw = views.raw_bars(spark, sf_dir)
    half = F.pmod(F.hash("symbol"), F.lit(2))
    counted = {r.half: r["count"] for r in raw.groupBy(half.alias("half")).count().collect()}
    each = files_of([counted.get(k, 0) for k in range(2)])
    for _turn in range(2):
        for k in range(2):
            # In parallel, and read so: a micro-batch takes so many files.
            raw.where(half == k).repartition(each).write.mode("append").parquet(f"{root}/feed")
    query = ingest_stream(
        spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", each).parquet(f"{root}/feed"), "ohlcv", f"{root}/lake", f"{root}/checkpoint"
    )
    query.awaitTermination()
    rows = current_rows(read_canonical(spark, f"{root}/lake", "ohlcv"), read_catalog(spark, f"{root}/lake", "registry"))
    return rows.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(*_SHOWN)


def ingest_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the raw news and join its registry, log and event rows."""
    root, registry = _ingested(spark, sf_dir, "news")
    log = read_catalog(spark, root, "ingestion_log")
    told = events.parse_events(read_catalog(spark, root, "events")).select("hash", "event")
    rows = registry.join(log.select("hash", "status", "rows_fetched"), "hash").join(told, "hash")
    return rows.select("symbol", "rows", "rows_fetched", "columns", "quality_passed", "status", "event", "hash")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered versions without stored rows and stored versions that nobody registered, after one side
    lost every series that did not pass its checks."""
    root, registry = _ingested(spark, sf_dir, "news")
    files = stored_files(spark, root, "news")
    folder = F.regexp_extract("path", "symbol=([^/]+)", 1)
    passed = registry.where("quality_passed")
    lost, _ = reconcile(registry, files.join(passed, folder == F.col("symbol"), "left_semi"))
    _, unknown = reconcile(passed, files)
    symbol = F.regexp_extract("place", "symbol=([^/]+)", 1).alias("symbol")
    return lost.select(F.lit("lost").alias("side"), "symbol").unionByName(unknown.select(F.lit("unknown").alias("side"), symbol))


def run_stream(stream: DataFrame, spark: SparkSession, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run a stream over all there is into Parquet files, a folder per micro-batch, and read them. A ``root`` that an earlier
    run had goes on from its checkpoint."""
    root = root or shared_folder(spark)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from a stream of ticks: those whose hour the watermark has passed."""
    ticks = views.as_ticks(views.stream(spark, sf_dir, "events"))
    bars = run_stream(tumbling_bars(ticks, "1h", "yahoo", delay="10 minutes"), spark)
    return bars.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(*_SHOWN)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows per timestamp from a stream of bars, once a day has gone by."""
    typed = views.as_typed_bars(views.as_raw_bars(views.stream(spark, sf_dir, "events")))
    bars = run_stream(first_by_seq(typed, delay="1 day"), spark)
    return bars.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(*_SHOWN)


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per day and data type from a stream of attempts: the days that are over."""
    failed = events.failed_events(views.as_attempts(views.stream(spark, sf_dir, "events")))
    counts = run_stream(running_counts(events.parse_events(failed), "1 day", "1 hour"), spark)
    return counts.select(iso_seconds(F.col("window_start")).alias("window_start"), "event", "data_type", "n")


QUERIES = {
    "stored_bars": stored_bars,
    "stored_versions": stored_versions,
    "compacted_bars": compacted_bars,
    "merged_coverage": merged_coverage,
    "lookup_hashes": lookup,
    "ingest_stream_bars": ingest_stream_bars,
    "ingest_news": ingest_news,
    "reconcile": reconciled,
    "stream_bars": stream_bars,
    "stream_dedup": stream_dedup,
    "stream_event_counts": stream_event_counts,
}

_BAR = "symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, open, high, low, close, volume"
_NEWS_HASH = (
    "sha256('{\"data_type\": \"news\", \"end\": \"2024-01-31\", \"provider\": \"news\", \"start\": \"2024-01-01\", "
    "\"symbol\": \"' || symbol || '\"}')"
)
_NEWS_RUN = """
    , fetched AS (SELECT upper(lang) AS symbol, count(*) AS rows_fetched FROM documents GROUP BY 1),
    kept AS (SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE published_at > TIMESTAMP '2024-01-31') = 0 AS passed
             FROM news GROUP BY symbol)
"""

ORACLES = {
    "stored_bars": over(["canonical_bars"], f"""
        SELECT {_BAR} FROM canonical_bars
        WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20'"""),
    "stored_versions": over(["canonical_bars"], """
        SELECT symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, open, high, low, close,
               CASE WHEN timestamp >= TIMESTAMP '2024-01-10' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS volume
        FROM canonical_bars"""),
    "merged_coverage": """
        WITH days AS (
            SELECT DISTINCT 'S' || (user_id % 20) AS symbol, CAST(ts AS DATE) AS day FROM events
            WHERE event_id % 101 <> 0 AND (user_id % 20 + day(ts)) % 7 <> 0
        ), ends AS (SELECT symbol, min(day) AS lo, max(day) AS hi, count(*) AS n FROM days GROUP BY symbol
        ), trading AS (
            SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d)
            WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15')
        ), lacking AS (
            SELECT symbol, day FROM ends, trading WHERE day BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM days WHERE days.symbol = ends.symbol AND days.day = trading.day))
        SELECT e.symbol, strftime(lo, '%Y-%m-%d') AS first_day, strftime(hi, '%Y-%m-%d') AS last_day, n AS n_days, count(l.day) AS n_missing,
               coalesce(strftime(min(l.day), '%Y-%m-%d'), '') AS first_missing
        FROM ends e LEFT JOIN lacking l ON l.symbol = e.symbol GROUP BY ALL""",
    "lookup_hashes": over(["stored_registry"], """
        SELECT hash, symbol, timeframe, rows, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(created_at) % 1000000 = 0 THEN ''
               ELSE strftime(created_at, '.%f') END || '+00:00' AS created_at
        FROM stored_registry WHERE symbol IN ('S1', 'S2', 'S3', 'S5', 'S8')"""),
    "compacted_bars": over(["canonical_bars"], """
        , phases AS (SELECT * FROM (VALUES ('compacted', TIMESTAMP '2024-01-25'), ('as of', NULL), ('expired', TIMESTAMP '2024-01-25')) t(phase, third))
        SELECT phase, symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, open, high, low, close,
               CASE WHEN timestamp >= third THEN 3.0::DOUBLE WHEN timestamp >= TIMESTAMP '2024-01-10' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS volume
        FROM canonical_bars, phases"""),
    "ingest_stream_bars": over(["canonical_bars"], f"SELECT {_BAR} FROM canonical_bars"),
    "ingest_news": over(["news"], f"""{_NEWS_RUN}
        SELECT symbol, rows, rows_fetched, 6 AS columns, passed AS quality_passed, 'success' AS status,
               'DatasetIngested' AS event, {_NEWS_HASH} AS hash
        FROM kept JOIN fetched USING (symbol)"""),
    "reconcile": over(["news"], f"""{_NEWS_RUN}
        SELECT side, symbol FROM kept CROSS JOIN (VALUES ('lost'), ('unknown')) AS t(side) WHERE NOT passed"""),
    "stream_bars": over(["bars_1h"], f"""
        SELECT {_BAR} FROM bars_1h
        WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE"""),
    "stream_dedup": over(["canonical_bars"], f"""
        SELECT {_BAR} FROM canonical_bars
        WHERE timestamp <= (SELECT max(timestamp) FROM typed_bars) - INTERVAL 1 DAY"""),
    "stream_event_counts": over(["attempts"], """
        , failed AS (SELECT * FROM attempts WHERE status = 'failed')
        SELECT strftime(date_trunc('day', completed_at), '%Y-%m-%dT%H:%M:%S') AS window_start, 'IngestionFailed' AS event,
               data_type, count(*) AS n
        FROM failed
        WHERE date_trunc('day', completed_at) + INTERVAL 1 DAY <= (SELECT max(completed_at) FROM failed) - INTERVAL 1 HOUR
        GROUP BY 1, 3"""),
}
