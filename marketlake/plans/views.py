"""The given tables in the canonical shapes: what the registered queries run on.

Every view covers its whole table. Defects are derived from row ids, so that both engines see the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.functions import dataset_hash, storage_uri
from marketlake.operators.calendar import exchange_calendar
from marketlake.operators.normalize import normalize_bars, normalize_macro, normalize_news
from marketlake.operators.resample import resample_bars
from marketlake.schemas import struct
from marketlake.session import configure

ROOT = "s3://lake"
START, END = "2024-01-01", "2024-01-31"
AS_OF = "2024-01-31 00:00:00"


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


# Declared, so that no job has to read footers first; naive timestamps are UTC.
_TABLES = {
    "events": struct(
        event_id="long", ts="timestamp", user_id="long", event_type="string", value="double", props="string"
    ),
    "documents": struct(doc_id="long", text="string", lang="string", source="string", n_chars="long"),
    "orders": struct(
        o_orderkey="long", o_custkey="long", o_orderstatus="string", o_totalprice="double", o_orderdate="timestamp",
        o_orderpriority="string",
    ),
    "customer": struct(
        c_custkey="long", c_name="string", c_nationkey="integer", c_acctbal="double", c_mktsegment="string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    reader = configure(spark).readStream.schema(_TABLES[name]).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(sf_dir)


def _label(prefix: str, number: str) -> F.Column:
    return F.concat(F.lit(prefix), F.expr(number).cast("string"))


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "user_id % 20") -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"), symbol)


def as_ticks(events: DataFrame, symbol: str = "user_id % 20") -> DataFrame:
    return events.select(
        _label("S", symbol).alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price")
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1d") -> DataFrame:
    return resample_bars(ticks(spark, sf_dir), timeframe, "yahoo")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string feed with many copies per (symbol, hour) and defects: unusable prices, no volume,
    high and low swapped, close outside of the range."""
    return as_raw_bars(table(spark, sf_dir, "events"))


def as_raw_bars(events: DataFrame) -> DataFrame:
    swapped, price = "event_id % 97 = 0", "value"
    return events.select(
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.expr(f"if(event_id % 101 = 0, 'n/a', cast({price} as string))").alias("Open"),
        F.expr(f"cast(if({swapped}, {price} - 1, {price} + 1) as string)").alias("High"),
        F.expr(f"cast(if({swapped}, {price} + 1, {price} - 1) as string)").alias("Low"),
        F.expr(f"cast(if(event_id % 89 = 0, {price} + 10, {price}) as string)").alias("Close"),
        F.expr("if(event_id % 53 = 0, '', cast(event_id % 10 as string))").alias("Volume"),
        _label("S", "user_id % 20").alias("symbol"),
        F.lit("1h").alias("timeframe"),
        F.lit("yahoo").alias("provider"),
        F.col("event_id").alias("seq"),
    )


def misdated_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw bars in lower case, some dated in other forms, some with a time that nobody can read, or none."""
    at = F.to_timestamp("Date")
    dated = F.when(F.expr("seq % 31 = 0"), "soon").when(F.expr("seq % 37 = 0"), None).when(F.expr("seq % 41 = 0"), "202401")
    dated = dated.when(F.expr("seq % 43 = 0"), F.date_format(at, "yyyyMMdd'T'HHmmss")).when(F.expr("seq % 47 = 0"), F.date_format(at, "M/d/yyyy H:mm:ss"))
    return raw_bars(spark, sf_dir).withColumns({"Date": dated.otherwise(F.col("Date")), "symbol": F.lower("symbol")})


def typed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw bars with types but with all their copies."""
    return as_typed_bars(raw_bars(spark, sf_dir))


def as_typed_bars(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.to_timestamp("Date").alias("timestamp"),
        *(F.col(c).try_cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")),
        "symbol",
        "timeframe",
        "provider",
        "seq",
    ).where(F.col("open").isNotNull())


def canonical_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_bars(raw_bars(spark, sf_dir))


def _published(doc_id: str = "doc_id") -> F.Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col(doc_id) * 3600)


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as articles, some with a blank headline or an unusable time."""
    return table(spark, sf_dir, "documents").select(
        F.expr("case when doc_id % 13 = 0 then ' \t' when doc_id % 17 = 0 then null else text end").alias("headline"),
        F.when(F.expr("doc_id % 11 = 0"), "soon").otherwise(
            F.date_format(_published(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("published_at"),
        "source",
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.upper("lang").alias("symbol"),
        F.lit("news").alias("provider"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_news(raw_news(spark, sf_dir))


def news_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON responses of at most 100 articles each, as the upstream pages them."""
    article = F.struct(
        F.expr("if(doc_id % 13 = 0, null, text)").alias("title"),
        F.when(F.expr("doc_id % 11 = 0"), "soon").otherwise(
            F.date_format(_published(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("publishedAt"),
        F.struct(F.col("source").alias("name")).alias("source"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
    )
    paged = table(spark, sf_dir, "documents").select(
        F.upper("lang").alias("symbol"), F.expr("doc_id div 100").alias("page"), article.alias("article")
    )
    body = F.to_json(F.struct(F.collect_list("article").alias("articles")))
    return paged.groupBy("symbol", "page").agg(body.alias("body"))


def broken_news_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news responses, of every five pages one cut off, one an error message and one without a body."""
    broken = F.when(F.expr("page % 5 = 1"), F.expr("left(body, length(body) div 2)")).when(F.expr("page % 5 = 2"), '{"status": "error"}')
    body = broken.when(F.expr("page % 5 = 3"), None).otherwise(F.col("body"))
    return news_responses(spark, sf_dir).select("symbol", "page", body.alias("body"))


def broken_rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS responses of at most 100 items each, of which some lack their end or have no usable date."""
    cut = F.when(F.expr("id % 7 = 1"), F.replace("xml", F.lit("</item>"), F.lit(""))).when(F.expr("id % 11 = 0"), F.regexp_replace("xml", "<pubDate>.*</pubDate>", "<pubDate>soon</pubDate>"))
    items = rss_items(spark, sf_dir).withColumn("id", F.regexp_extract("xml", "news.example/([0-9]+)</link>", 1).cast("long"))
    items = items.select("symbol", F.expr("id div 100").alias("page"), cut.otherwise(F.col("xml")).alias("xml"))
    body = F.concat(F.lit("<rss><channel><title>news</title>"), F.array_join(F.collect_list("xml"), "\n"), F.lit("</channel></rss>"))
    return items.groupBy("symbol", "page").agg(body.alias("body"))


def broken_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fundamentals' responses, some cut off, some without a body."""
    body = F.when(F.expr("seq % 11 = 0"), F.left("body", F.lit(5))).when(F.expr("seq % 13 = 0"), None).otherwise(F.col("body"))
    return raw_fundamentals(spark, sf_dir).withColumn("body", body)


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RSS item of XML per document."""
    escaped = F.col("text")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    date = F.date_format(_published(), "EEE, dd MMM yyyy HH:mm:ss")
    zone = F.when(F.expr("doc_id % 2 = 0"), " +0000").otherwise(" GMT")
    xml = F.concat(
        F.lit("<item><title>"), escaped, F.lit("</title><link>https://news.example/"), F.col("doc_id").cast("string"),
        F.lit("</link><pubDate>"), date, zone, F.lit("</pubDate></item>"),
    )
    return table(spark, sf_dir, "documents").select(F.upper("lang").alias("symbol"), xml.alias("xml"))


def raw_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots per customer as JSON objects, keyed by the upstream names; one in seven has a bad number."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    info = F.struct(
        F.when(F.expr("o_orderkey % 7 = 0"), "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("marketCap"),
        F.col("c_acctbal").cast("string").alias("trailingEps"),
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("symbol"),
        F.to_json(info).alias("body"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+05:00'").alias("taken"),
        F.col("o_orderkey").alias("seq"),
        F.lit("yahoo").alias("provider"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    none = [F.lit(None).cast("double").alias(c) for c in ("pe_ratio", "pb_ratio", "revenue_growth", "earnings_surprise")]
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("symbol"),
        F.col("o_orderdate").alias("as_of"),
        *none,
        F.col("o_totalprice").alias("market_cap"),
        F.col("c_acctbal").alias("eps"),
        F.lit("yahoo").alias("provider"),
        F.col("o_orderkey").alias("seq"),
    )


def raw_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly maxima per order priority, under upstream ids; one priority has no known id."""
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month"))
        .agg(F.max("o_totalprice").alias("value"), F.count("*").alias("n"))
    )
    ids = F.expr(
        "case substr(o_orderpriority, 1, 1) when '1' then 'CPIAUCSL' when '2' then 'FEDFUNDS' "
        "when '3' then 'A191RL1Q225SBEA' when '4' then 'UNRATE' else 'NO_SUCH_ID' end"
    )
    return monthly.select(
        ids.alias("series_id"),
        F.date_format("month", "yyyy-MM-dd").alias("date"),
        F.when(F.col("n") % 13 == 0, None).otherwise(F.col("value").cast("string")).alias("value"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("value"))
    )
    return normalize_macro(monthly.select("date", "series", "value"), provider="fred")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_attempts(table(spark, sf_dir, "events"))


def as_attempts(events: DataFrame) -> DataFrame:
    """The events as ingestion attempts; only a purchase is a success."""
    return events.select(
        _label("P", "user_id % 3").alias("provider"),
        F.expr("elt(1 + user_id % 4, 'ohlcv', 'news', 'fundamentals', 'macro')").alias("data_type"),
        _label("S", "user_id % 20").alias("symbol"),
        F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"),
        F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("error"),
        F.col("ts").alias("completed_at"),
        F.col("event_id").alias("log_id"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of many versions: bars per (user, day), news per (language, source), macro per priority."""
    none = F.lit(None).cast("string")
    of_bars = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.count("*").alias("rows"),
            F.max("ts").alias("created_at"),
            F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"),
        )
        .select(
            F.lit("yahoo").alias("provider"), F.lit("ohlcv").alias("data_type"), _label("S", "user_id").alias("symbol"),
            F.expr("if(user_id % 2 = 0, '1d', '1h')").alias("timeframe"), none.alias("series"),
            "rows", F.lit(9).alias("columns"), (F.col("n_errors") == 0).alias("quality_passed"), "created_at",
        )
    )
    of_news = (
        table(spark, sf_dir, "documents")
        .groupBy("lang", "source")
        .agg(F.count("*").alias("rows"), F.max("doc_id").alias("last"))
        .select(
            F.lit("news").alias("provider"), F.lit("news").alias("data_type"),
            F.upper(F.concat_ws("-", "lang", "source")).alias("symbol"), none.alias("timeframe"), none.alias("series"),
            "rows", F.lit(6).alias("columns"), F.lit(True).alias("quality_passed"),
            F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.expr("last % 720 * 3600")).alias("created_at"),
        )
    )
    of_macro = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("rows"))
        .select(
            F.lit("fred").alias("provider"), F.lit("macro").alias("data_type"), none.alias("symbol"), none.alias("timeframe"),
            F.upper("o_orderpriority").alias("series"), "rows", F.lit(4).alias("columns"), F.lit(True).alias("quality_passed"),
            F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.expr("rows % 720 * 3600")).alias("created_at"),
        )
    )
    rows = of_bars.unionByName(of_news).unionByName(of_macro)
    rows = rows.withColumns({"start_date": F.lit(START), "end_date": F.lit(END)})
    key = dataset_hash(*(F.col(c) for c in ("data_type", "provider", "symbol", "timeframe", "start_date", "end_date", "series")))
    rows = rows.withColumn("hash", key)
    uri = storage_uri(ROOT, *(F.col(c) for c in ("data_type", "symbol", "timeframe", "series", "start_date", "hash")))
    issues = F.when(~F.col("quality_passed"), F.array(F.lit("error events")))
    return rows.withColumns({"storage_uri": uri, "quality_issues": issues})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-warm manifest for every user's symbol."""
    from marketlake.operators.catalog import request_manifest

    symbols = table(spark, sf_dir, "events").select(_label("s", "user_id").alias("symbol")).distinct()
    return request_manifest(symbols, START, END, timeframes=("1d", "1h"))


def user_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trading days of New York in the range the events cover."""
    return exchange_days(spark, sf_dir).where("exchange = 'XNYS'").select("day")


def exchange_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days per exchange, of the range the events cover."""
    first, last = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).cast("string"), F.to_date(F.max("ts")).cast("string")).first()
    return exchange_calendar(spark, first or START, last or START)
