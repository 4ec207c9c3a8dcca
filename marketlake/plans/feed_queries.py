"""Registered queries on feeds in their file formats, stored order, typed reads, symbol lists, and streams over several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake import schemas
from marketlake.functions import iso_created_at, iso_day, iso_seconds
from marketlake.operators import events
from marketlake.operators.normalize import normalize_bars, normalize_news
from marketlake.operators.reads import get_bars
from marketlake.operators.resample import resample_bars
from marketlake.operators.universe import symbol_lists, symbol_universe, symbols_of
from marketlake.plans import views
from marketlake.plans.lake_queries import files_of, run_stream
from marketlake.plans.oracle_views import over
from marketlake.session import shared_folder
from marketlake.sinks.event_sink import append_events, committed_batches
from marketlake.sinks.store import write_canonical, write_catalog
from marketlake.sources import feeds
from marketlake.sources.feeds import read_raw_bars
from marketlake.sources.lake import read_canonical, read_catalog
from marketlake.streaming.lineage import lineage_stream
from marketlake.streaming import alerts, bars as bar_streams, events as event_streams, windows

_SHOWN = ("symbol", "timestamp", *schemas.PRICES, "volume")
#: Files, and so micro-batches, that a registered stream reads.
FILES = 3


def _shown(bars: DataFrame) -> DataFrame:
    return bars.withColumn("timestamp", iso_seconds(F.col("timestamp"))).select(*_SHOWN)


def _format(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/feed"
        writer = views.raw_bars(spark, sf_dir).write.format(fmt)
        (writer.option("header", "true").option("emptyValue", "") if fmt == "csv" else writer).save(path)
        return _shown(normalize_bars(read_raw_bars(spark, path, fmt)))

    return query


def nan_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed read of bars of which some prices are not a number: those are null."""
    bars = views.bars(spark, sf_dir, "1h")
    holed = bars.withColumn("close", F.when(F.hour("timestamp") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("close")))
    rows = get_bars(holed, None, "1h", "2024-01-05", "2024-01-20", typed=True)
    return rows.select("symbol", iso_seconds(F.col("timestamp")).alias("timestamp"), "open", "close", F.col("close").isNull().alias("no_close"))


def absent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of feeds that lack a required or an optional column: none without a required one, all without an optional one."""
    raw, news = views.raw_bars(spark, sf_dir), views.raw_news(spark, sf_dir)
    cases = {"bars without Close": normalize_bars(raw.drop("Close")), "bars without a time": normalize_bars(raw.drop("Date")), "news without headline": normalize_news(news.drop("headline"))}
    out = normalize_news(news.drop("source", "url")).groupBy("symbol").agg(F.count("*").alias("n"), F.count("source").alias("n_source"))
    out = out.select(F.lit("news without source and url").alias("feed"), "symbol", "n", "n_source")
    for name, df in cases.items():
        counted = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("feed"), F.lit("").alias("symbol"), "n", F.lit(0).cast("bigint").alias("n_source"))
        out = out.unionByName(counted)
    return out


def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per symbol as stored, and how many stand before an earlier one in their file: none."""
    root = shared_folder(spark)
    write_canonical(views.canonical_bars(spark, sf_dir), "ohlcv", root, "r1", views.as_of())
    # One task per file piece reads it from front to back, so the id rises with the place in the file.
    placed = read_canonical(spark, root, "ohlcv").select("symbol", "timestamp", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    ranked = placed.selectExpr("*", "row_number() OVER (PARTITION BY file ORDER BY place) AS a", "row_number() OVER (PARTITION BY file ORDER BY timestamp) AS b")
    return ranked.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_out_of_order"))


def malformed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every record of four feeds with broken responses, items, snapshots and lines: per feed, symbol and reason their
    number; no reason: they gave a row."""
    news, fundamentals = views.broken_news_responses(spark, sf_dir), views.broken_fundamentals(spark, sf_dir)
    rss = feeds.rss_records(views.broken_rss_feeds(spark, sf_dir).select("symbol", "body"))
    path, columns = f"{shared_folder(spark)}/lines", [F.coalesce(f.name, F.lit("")).cast("string") for f in feeds.RAW_BARS]
    cut = F.when(F.expr("seq % 113 = 0"), F.concat_ws(",", *columns[:2])).otherwise(F.concat_ws(",", *columns))
    views.raw_bars(spark, sf_dir).select(cut).write.text(path)
    lines, bad_lines = feeds.split_malformed(feeds.read_raw_bars(spark, path, keep_malformed=True, header="false"))
    bad_snapshots = feeds.rejected_fundamentals(fundamentals)
    read = {
        "news": (feeds.parse_news_json(news), feeds.rejected_news(news)),
        "rss": (feeds.parse_rss_items(feeds.read_rss_items(rss)), feeds.rejected_rss(rss)),
        "fundamentals": (feeds.parse_fundamentals_json(fundamentals, views.as_of()).where("coalesce(market_cap, eps) is not null"), bad_snapshots),
        "bars": (lines, bad_lines),
    }
    out = None
    for feed, (kept, rejected) in read.items():
        both = kept.select("symbol", F.lit("").alias("reason")).unionByName(rejected.select("symbol", "reason"))
        told = both.groupBy(F.lit(feed).alias("feed"), F.coalesce("symbol", F.lit("")).alias("symbol"), "reason").agg(F.count("*").alias("n"))
        out = told if out is None else out.unionByName(told)
    return out


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.ticks(spark, sf_dir, "user_id").withColumn("provider", F.lit("yahoo"))
    return symbol_universe(bars, views.raw_news(spark, sf_dir))


def provider_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_of(_universe(spark, sf_dir), "news")


def provider_symbol_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol lists per provider: their number of symbols, and all of them in order where one list holds a provider."""
    lists = symbol_lists(_universe(spark, sf_dir), buckets=1)
    return lists.select("provider", F.size("symbols").cast("bigint").alias("n"), F.array_join("symbols", ",").alias("symbols"))


def in_files(df: DataFrame, path: str, at: str, files: int = FILES) -> DataFrame:
    """``df`` as ``files`` equal time spans that arrive one after the other, and the stream of them, a span per micro-batch.

    A span is written in parallel, as many files for each; rows without a time come with the last one.
    """
    first, last = df.agg(F.unix_micros(F.min(at)), F.unix_micros(F.max(at))).first()
    spark, width = df.sparkSession, ((last or 0) - (first or 0)) // files + 1
    span = F.coalesce(F.floor((F.unix_micros(at) - (first or 0)) / width), F.lit(files - 1)).cast("int")
    sizes = [r["count"] for r in df.groupBy(span.alias("span")).count().collect()]
    # Dealt out evenly, so that no file of a span is missing: a micro-batch takes so many files.
    each = files_of(sizes)
    for k in range(files):
        df.where(span == k).repartition(each).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def in_batches(spark: SparkSession, df: DataFrame, batch: F.Column, closing: DataFrame, build, mode: str = "append") -> DataFrame:
    """What a stream gives over ``df`` in the batches 0, 1, … that a column names, and then over ``closing``: rows far in the
    future, after which nothing stays open. ``build`` makes the streaming query of the raw stream. Each batch is written in
    parallel, and one run of the query, which goes on from the last one's checkpoint."""
    root, numbered = shared_folder(spark), df.withColumn("_batch", batch)
    last = numbered.agg(F.max("_batch")).first()[0]
    out = None
    for k in range((last if last is not None else -1) + 2):
        part = numbered.where(F.col("_batch") == k).drop("_batch") if last is not None and k <= last else closing.select(*df.columns)
        part.write.mode("append").parquet(f"{root}/in")
        out = _stateful(spark, build(spark.readStream.schema(df.schema).parquet(f"{root}/in")), mode, root)
    return out


def stream_bars_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from ticks in several micro-batches: hours that span two of them are whole."""
    ticks = in_files(views.ticks(spark, sf_dir), f"{shared_folder(spark)}/in", "ts")
    return _shown(run_stream(bar_streams.tumbling_bars(ticks, "1h", "yahoo", delay="10 minutes"), spark))


def stream_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which (series, hour) came, each once, over several micro-batches that send every row twice."""
    bars = views.typed_bars(spark, sf_dir)
    twice = in_files(bars.unionByName(bars), f"{shared_folder(spark)}/in", "timestamp")
    out = run_stream(bar_streams.first_arrivals(twice), spark)
    return out.select("symbol", iso_seconds(F.col("timestamp")).alias("timestamp"))


def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per day and data type from the stored event log, written by several runs."""
    root, failed = shared_folder(spark), events.failed_events(views.attempts(spark, sf_dir))
    for k in range(FILES):
        write_catalog(failed.where(F.dayofmonth("published_at") % FILES == k), "events", root, f"r{k}")
    counts = run_stream(event_streams.running_counts(event_streams.read_events(spark, root), "1 day", "1 hour"), spark)
    return counts.select(iso_seconds(F.col("window_start")).alias("window_start"), "event", "data_type", "n")


def _stateful(spark: SparkSession, stream: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Run a stream with Python state, which needs the RocksDB state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_stream(stream, spark, mode, root)
    finally:
        spark.conf.set(name, before)


def stream_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages as a stream of attempts left them: the last extent of every run."""
    log = in_files(views.attempts(spark, sf_dir), f"{shared_folder(spark)}/in", "completed_at")
    seen = _stateful(spark, alerts.outage_alerts(log, keys=["provider"], gap_seconds=43_200), "update")
    final = seen.groupBy("provider", "started_at").agg(F.max("ended_at").alias("ended_at"), F.max("n_failures").alias("n_failures"))
    times = {c: iso_created_at(F.col(c)) for c in ("started_at", "ended_at")}
    return final.withColumns(times).select("provider", "started_at", "ended_at", "n_failures")


def stream_unordered_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages of attempts that come in three unordered batches: those of the whole log."""
    log = views.attempts(spark, sf_dir)
    values = {"provider": F.lit("~"), "status": F.lit("success"), "completed_at": F.lit(_FAR)}
    closing = spark.range(1).select(*(values.get(c, F.lit(None)).cast(log.schema[c].dataType).alias(c) for c in log.columns))
    build = lambda s: alerts.unordered_outages(s, ["provider"], "log_id", "2 days", gap_seconds=43_200)
    found = in_batches(spark, log, _unordered("completed_at", "log_id"), closing, build)
    times = {c: iso_created_at(F.col(c)) for c in ("started_at", "ended_at")}
    return found.where("kind = 'outage'").withColumns(times).select("provider", "started_at", "ended_at", "n_failures")


def stream_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log and the registry as two streams of three batches each, the registry's a batch behind: what ``lineage`` gives."""
    root, registry = shared_folder(spark), views.registry(spark, sf_dir)
    log = registry.select("hash", "created_at", "provider", "data_type", F.lit("success").alias("status"))
    kept = registry.where("quality_passed").select("hash", "created_at", "storage_uri", F.col("rows").cast("long").alias("rows"), "quality_passed")
    batch = F.floor(F.dayofmonth("created_at") / 11)  # days 1 to 10, 11 to 21, 22 to 31

    def far(df: DataFrame) -> DataFrame:
        values = {"hash": F.lit("~"), "created_at": F.lit(_FAR)}
        return spark.range(1).select(*(values.get(c, F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns))

    out = None
    for k in range(5):
        for name, df, turn in (("log", log, k), ("registry", kept, k - 1)):
            part = far(df) if k == 4 else df.where(batch == turn)
            part.write.mode("append").parquet(f"{root}/{name}")
        streams = (spark.readStream.schema(df.schema).parquet(f"{root}/{name}") for name, df in (("log", log), ("registry", kept)))
        out = run_stream(lineage_stream(*streams, delay="15 days"), spark, root=root)
    return out.where("hash <> '~'").select(
        "hash", iso_created_at(F.col("created_at")).alias("created_at"), "provider", "data_type",
        F.coalesce("rows", F.lit(-1)).alias("rows"), F.col("storage_uri").isNull().alias("orphan"),
    )


def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures per day and data type in the event log that a stream wrote, ended, and wrote all over again."""
    root, failed = shared_folder(spark), events.failed_events(views.attempts(spark, sf_dir))
    for turn in range(2):
        # Its first checkpoint lost, the second run begins at the first file.
        stream = in_files(failed, f"{root}/in", "published_at") if turn == 0 else stream
        append_events(stream, root, "replay", f"{root}/checkpoint-{turn}").awaitTermination()
    told = events.parse_events(read_catalog(spark, root, "events"))
    counts = told.groupBy(F.to_date("published_at").cast("string").alias("day"), "data_type").agg(F.count("*").alias("n"))
    # And what the sink noted of its batches says the same.
    noted = committed_batches(spark, root).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    return counts.unionByName(noted.select(F.lit("noted").alias("day"), F.lit("").alias("data_type"), "n"))


def stream_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes that moved by more than the threshold, over several micro-batches."""
    bars = in_files(resample_bars(views.ticks(spark, sf_dir), "1d", "yahoo"), f"{shared_folder(spark)}/in", "timestamp")
    found = _stateful(spark, alerts.spike_alerts(bars), "append")
    return found.select("symbol", iso_day(F.col("timestamp")).alias("day"), "close", "prior_close")


def stream_price_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of which any price moved by more than the threshold from the close before, over several micro-batches."""
    bars = in_files(resample_bars(views.ticks(spark, sf_dir), "1d", "yahoo"), f"{shared_folder(spark)}/in", "timestamp")
    found = _stateful(spark, alerts.spike_alerts(bars, prices=schemas.PRICES), "append")
    return found.select("symbol", iso_day(F.col("timestamp")).alias("day"), *schemas.PRICES, "prior_close")


#: A tick after all that the given table can hold: it moves the watermark past every bar.
_FAR = "2100-01-01"


def _far_tick(spark: SparkSession, ticks: DataFrame) -> DataFrame:
    values = {"symbol": F.lit("~"), "ts": F.lit(_FAR).cast("timestamp"), "seq": F.lit(0).cast("long"), "price": F.lit(0.0)}
    return spark.range(1).select(*(values[c].cast(ticks.schema[c].dataType).alias(c) for c in ticks.columns))


def _unordered(at: str, seq: str) -> F.Column:
    """Which of three batches a row comes in: rows are held back by up to a day, so that the batches' times overlap."""
    held = F.col(at) + F.make_dt_interval(hours=(F.col(seq) % 5) * 6)
    return F.when(held < F.lit("2024-01-11").cast("timestamp"), 0).when(held < F.lit("2024-01-21").cast("timestamp"), 1).otherwise(2)


def stream_late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars and late ticks of a stream in three unordered batches: together, every tick of the input once."""
    ticks = views.ticks(spark, sf_dir)
    build = lambda s: windows.bars_and_late_ticks(s, "1d", delay="2 hours")
    found = in_batches(spark, ticks, _unordered("ts", "seq"), _far_tick(spark, ticks), build)
    late = windows.late_ticks(found).groupBy("symbol", "timestamp").agg(F.count("*").cast("double").alias("volume"), F.sum("seq").alias("seqs"))
    bars = windows.closed_bars(found, "1d", "yahoo").select(F.lit("bar").alias("kind"), *_SHOWN)
    told = bars.unionByName(late.withColumn("kind", F.lit("late")), allowMissingColumns=True)
    return told.withColumns({"timestamp": iso_seconds(F.col("timestamp")), "seqs": F.coalesce("seqs", F.lit(-1))})


def stream_bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of calendar months from a stream in several batches, after the last month was over."""
    ticks = views.ticks(spark, sf_dir)
    build = lambda s: windows.bars_and_late_ticks(s, "1m", delay="2 days")
    found = in_batches(spark, ticks, _unordered("ts", "seq"), _far_tick(spark, ticks), build)
    return _shown(windows.closed_bars(found, "1m", "yahoo"))


QUERIES = {
    **{f"raw_bars_{fmt}": _format(fmt) for fmt in ("csv", "json", "parquet")},
    "nan_prices": nan_prices,
    "absent_columns": absent_columns,
    "stored_order": stored_order,
    "malformed_feeds": malformed_feeds,
    "provider_symbols": provider_symbols,
    "provider_symbol_lists": provider_symbol_lists,
    "stream_bars_in_files": stream_bars_in_files,
    "stream_first_arrivals": stream_first_arrivals,
    "stream_late_ticks": stream_late_ticks,
    "stream_bars_1m": stream_bars_1m,
    "stream_event_log": stream_event_log,
    "stream_outages": stream_outages,
    "stream_unordered_outages": stream_unordered_outages,
    "stream_lineage": stream_lineage,
    "replayed_events": replayed_events,
    "stream_spikes": stream_spikes,
    "stream_price_spikes": stream_price_spikes,
}

_BAR = "symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, open, high, low, close, volume"


def _oracles() -> dict[str, str]:
    from marketlake.plans import catalog_queries, lake_queries

    return {
        **{f"raw_bars_{fmt}": over(["canonical_bars"], f"SELECT {_BAR} FROM canonical_bars") for fmt in ("csv", "json", "parquet")},
        "nan_prices": over(["bars_1h"], """
            SELECT symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, open,
                   CASE WHEN hour(timestamp) % 5 <> 0 THEN close END AS close, hour(timestamp) % 5 = 0 AS no_close
            FROM bars_1h WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20'"""),
        "absent_columns": over(["news"], """
            SELECT 'news without source and url' AS feed, symbol, count(*) AS n, 0::BIGINT AS n_source FROM news GROUP BY symbol
            UNION ALL SELECT f, '', 0::BIGINT, 0::BIGINT FROM (VALUES ('bars without Close'), ('bars without a time'), ('news without headline')) t(f)"""),
        "stored_order": over(["canonical_bars"], "SELECT symbol, count(*) AS n, 0::BIGINT AS n_out_of_order FROM canonical_bars GROUP BY symbol"),
        "malformed_feeds": """
            WITH news AS (
                SELECT upper(lang) AS symbol, doc_id // 100 AS page, doc_id FROM documents
            ), pages AS (
                SELECT DISTINCT symbol, CASE page % 5 WHEN 1 THEN 'malformed JSON' WHEN 2 THEN 'no articles' WHEN 3 THEN 'no body' END AS reason, page FROM news
            ), told AS (
                SELECT 'news' AS feed, symbol, reason FROM pages WHERE reason IS NOT NULL
                UNION ALL SELECT 'news', symbol, CASE WHEN doc_id % 11 = 0 THEN 'no usable time' ELSE '' END FROM news WHERE page % 5 IN (0, 4)
                UNION ALL SELECT 'rss', symbol, CASE WHEN doc_id % 7 = 1 THEN 'malformed XML' WHEN doc_id % 11 = 0 THEN 'no usable time' ELSE '' END FROM news
                UNION ALL SELECT 'fundamentals', c_name, CASE WHEN o_orderkey % 11 = 0 THEN 'malformed JSON' WHEN o_orderkey % 13 = 0 THEN 'no body' ELSE '' END
                FROM orders JOIN customer ON o_custkey = c_custkey
                UNION ALL SELECT 'bars', CASE WHEN event_id % 113 = 0 THEN '' ELSE 'S' || (user_id % 20) END, CASE WHEN event_id % 113 = 0 THEN 'malformed line' ELSE '' END
                FROM events)
            SELECT feed, symbol, reason, count(*) AS n FROM told GROUP BY ALL""",
        "provider_symbols": "SELECT DISTINCT upper(lang) AS symbol FROM documents WHERE lang IS NOT NULL",
        "provider_symbol_lists": """
            SELECT provider, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM (
                SELECT DISTINCT 'yahoo' AS provider, 'S' || user_id AS symbol FROM events
                UNION SELECT DISTINCT 'news', upper(lang) FROM documents WHERE lang IS NOT NULL)
            GROUP BY provider""",
        "stream_bars_in_files": lake_queries.ORACLES["stream_bars"],
        "stream_first_arrivals": over(["typed_bars"], """
            SELECT DISTINCT symbol, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM typed_bars"""),
        # The watermark of a batch is two hours behind the latest tick of those before it; the last batch closes all.
        "stream_late_ticks": over(["ticks"], """
            , placed AS (
                SELECT *, date_trunc('day', ts) AS day, CASE WHEN ts + to_hours((6 * (seq % 5))::INTEGER) < TIMESTAMP '2024-01-11' THEN 0
                    WHEN ts + to_hours((6 * (seq % 5))::INTEGER) < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch
                FROM ticks),
            marks AS (SELECT b AS batch, (SELECT max(ts) FROM placed WHERE batch < b) - INTERVAL 2 HOUR AS mark FROM range(3) t(b)),
            judged AS (SELECT placed.*, coalesce(day + INTERVAL 1 DAY <= mark, false) AS late FROM placed JOIN marks USING (batch))
            SELECT 'bar' AS kind, symbol, strftime(day, '%Y-%m-%dT%H:%M:%S') AS timestamp, first(price ORDER BY ts, seq) AS open, max(price) AS high,
                min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*)::DOUBLE AS volume, -1::BIGINT AS seqs
            FROM judged WHERE NOT late GROUP BY symbol, day
            UNION ALL
            SELECT 'late', symbol, strftime(day, '%Y-%m-%dT%H:%M:%S'), NULL, NULL, NULL, NULL, count(*)::DOUBLE, sum(seq)::BIGINT
            FROM judged WHERE late GROUP BY symbol, day"""),
        "stream_bars_1m": over(["ticks"], """
            SELECT symbol, strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, first(price ORDER BY ts, seq) AS open, max(price) AS high,
                min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*)::DOUBLE AS volume
            FROM ticks GROUP BY symbol, date_trunc('month', ts)"""),
        "stream_event_log": lake_queries.ORACLES["stream_event_counts"],
        "stream_outages": catalog_queries.ORACLES["outages"],
        "replayed_events": over(["attempts"], """
            SELECT strftime(completed_at, '%Y-%m-%d') AS day, data_type, count(*) AS n FROM attempts WHERE status = 'failed' GROUP BY ALL
            UNION ALL SELECT 'noted', '', count(*) FROM attempts WHERE status = 'failed'"""),
        "stream_lineage": catalog_queries.ORACLES["lineage"],
        "stream_unordered_outages": catalog_queries.ORACLES["outages"],
        "stream_spikes": over(["bars_1d"], """
            SELECT symbol, strftime(timestamp, '%Y-%m-%d') AS day, close, prior_close
            FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS prior_close FROM bars_1d)
            WHERE prior_close IS NOT NULL AND CASE WHEN prior_close = 0 THEN true ELSE abs((close - prior_close) / prior_close) > 0.2 END"""),
        "stream_price_spikes": over(["bars_1d"], """
            SELECT symbol, strftime(timestamp, '%Y-%m-%d') AS day, open, high, low, close, prior_close
            FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS prior_close FROM bars_1d)
            WHERE prior_close IS NOT NULL AND (
                CASE WHEN prior_close = 0 THEN true ELSE abs((open - prior_close) / prior_close) > 0.2 END
                OR CASE WHEN prior_close = 0 THEN true ELSE abs((high - prior_close) / prior_close) > 0.2 END
                OR CASE WHEN prior_close = 0 THEN true ELSE abs((low - prior_close) / prior_close) > 0.2 END
                OR CASE WHEN prior_close = 0 THEN true ELSE abs((close - prior_close) / prior_close) > 0.2 END)"""),
    }


ORACLES = _oracles()
