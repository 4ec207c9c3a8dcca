"""Raw feeds: bars, news (JSON and RSS), fundamentals and macro series, for all symbols at once.

Whatever a parser leaves out, its ``rejected_…`` twin returns as (keys…, record, reason), for the rejects of an ingestion run: every
response is accounted for by rows, by rejects, or by both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marketlake import schemas
from marketlake.functions import iso_day, iso_z_timestamp, rfc2822_timestamp

# Raw columns are read as strings and cast by the normalizers; `seq` is the feed's own row order.
RAW_BARS = schemas.struct(
    Date="string", Open="string", High="string", Low="string", Close="string", Volume="string",
    symbol="string", timeframe="string", provider="string", seq="long",
)
RAW_MACRO = schemas.struct(series_id="string", date="string", value="string")
RSS_ITEM = schemas.struct(title="string", link="string", pubDate="string")

#: Where Spark's readers leave a record that they can't read; the parsers here name the reason.
CORRUPT = "_corrupt_record"

NEWS_RESPONSE = "articles ARRAY<STRUCT<title STRING, publishedAt STRING, source STRUCT<name STRING>, url STRING>>"

# Fixed value: the source name of articles that come by RSS.
RSS_SOURCE = "Yahoo Finance"

# Upstream names of the fundamental metrics.
FUNDAMENTAL_KEYS = {
    "trailingPE": "pe_ratio",
    "priceToBook": "pb_ratio",
    "revenueGrowth": "revenue_growth",
    "earningsSurprise": "earnings_surprise",
    "marketCap": "market_cap",
    "trailingEps": "eps",
}

# Upstream ids of the macro series.
MACRO_SERIES_IDS = {
    "CPI": "CPIAUCSL",
    "FED_FUNDS_RATE": "FEDFUNDS",
    "GDP_GROWTH": "A191RL1Q225SBEA",
    "UNEMPLOYMENT": "UNRATE",
}


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType, **options: str) -> DataFrame:
    if fmt == "csv":
        options = {"header": "true", "enforceSchema": "false"} | options
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_raw_bars(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = RAW_BARS, keep_malformed: bool = False, **options: str
) -> DataFrame:
    """Bars as delivered, from CSV, JSON or Parquet files. ``keep_malformed`` adds the text of lines that have not the feed's
    columns, for ``split_malformed``; else such lines come as far as they can be read."""
    if keep_malformed and fmt in ("csv", "json"):
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        # Whatever a query reads, lines are judged on all of their columns.
        options = {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"} | options
    return _read(spark, path, fmt, schema, **options)


def split_malformed(raw: DataFrame, keys: Sequence[str] = ("symbol",)) -> tuple[DataFrame, DataFrame]:
    """(records that could be read, the others as (keys…, record, reason)) of a feed read with ``keep_malformed``."""
    if CORRUPT not in raw.columns:
        return raw, raw.limit(0).select(*keys, F.lit("").alias("record"), F.lit("").alias("reason"))
    good = F.col(CORRUPT).isNull()
    # The readers refuse a query on nothing but the corrupt column: this condition, always true, reads another one.
    other = F.length(F.coalesce(F.col(next(c for c in raw.columns if c != CORRUPT)).cast("string"), F.lit(""))) >= 0
    rejected = raw.where(~good & other).select(*keys, F.col(CORRUPT).alias("record"), F.lit("malformed line").alias("reason"))
    return raw.where(good & other).drop(CORRUPT), rejected


def read_raw_macro(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """Macro points as delivered: ``series_id, date, value``."""
    return _read(spark, path, fmt, RAW_MACRO, **options)


def _carried(df: DataFrame, names: Sequence[str] = ("symbol", "provider")) -> list[str]:
    """Which of the columns that name a record's series the feed has."""
    return [c for c in names if c in df.columns]


def _absent(body: str) -> Column:
    return F.col(body).isNull() | (F.trim(F.col(body)) == "")


def _read_responses(responses: DataFrame, body: str, language: str | None) -> DataFrame:
    """Responses with their ``articles`` and, where these could not be read, or not in full, the ``reason``."""
    if language is not None and "language" in responses.columns:
        responses = responses.where(F.col("language") == language)
    parsed = F.from_json(body, f"{NEWS_RESPONSE}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    read = responses.withColumn("parsed", parsed)
    broken, none = F.col("parsed")[CORRUPT].isNotNull(), F.col("parsed.articles").isNull()
    reason = F.when(_absent(body), "no body").when(none & broken, "malformed JSON").when(none, "no articles")
    reason = reason.when(broken, "malformed in part")
    return read.withColumns({"articles": F.col("parsed.articles"), "reason": reason})


def parse_news_json(responses: DataFrame, body: str = "body", language: str | None = "en") -> DataFrame:
    """Articles from JSON responses (``symbol, body`` and maybe ``language``): all of every response.

    Articles without a usable time are skipped, a null title becomes empty. A response is one page of
    upstream already, so nothing is cut here. What is left out, ``rejected_news`` has.
    """
    return _read_responses(responses, body, language).select("symbol", F.explode("articles").alias("a")).select(
        F.coalesce("a.title", F.lit("")).alias("headline"),
        iso_z_timestamp(F.col("a.publishedAt")).alias("published_at"),
        F.col("a.source.name").alias("source"),
        F.col("a.url").alias("url"),
        "symbol",
    ).where(F.col("published_at").isNotNull())


def rejected_news(responses: DataFrame, body: str = "body", language: str | None = "en") -> DataFrame:
    """(symbol, …, record, reason) of whole responses that have no articles, of those read in part, and of single articles
    without a usable time. Row by row, one pass."""
    read = _read_responses(responses, body, language)
    kind = "array<struct<record: string, reason: string>>"
    whole = F.when(F.col("reason").isNotNull(), F.array(F.struct(F.col(body).alias("record"), "reason")))
    undated = F.filter("articles", lambda a: iso_z_timestamp(a.publishedAt).isNull())
    single = F.transform(undated, lambda a: F.struct(F.to_json(a).alias("record"), F.lit("no usable time").alias("reason")))
    found = F.concat(*(F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (whole, single)))
    return read.select(*_carried(responses), F.inline(found))


def read_news_rss(spark: SparkSession, path: str, symbol: str | None = r"([^/]+)\.xml$") -> DataFrame:
    """RSS files of many symbols, one row per item, with the file it is from.

    ``symbol`` is the pattern whose first group takes the symbol out of the file's path (default: the file's name). The reader gives up
    on a file at its first broken item; ``read_rss_records`` does not.
    """
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    items = items.withColumn("path", F.col("_metadata.file_path"))
    return items if symbol is None else items.withColumn("symbol", F.upper(F.url_decode(F.regexp_extract("path", symbol, 1))))


def rss_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """Every item of RSS responses as a text (``xml``) of its own, with the other columns of its response: a broken item takes no
    other along. An item goes from where it starts to its end, or to the next start where it has none. A response without
    any item is one row without an ``xml``."""
    rest = [c for c in responses.columns if c != body]
    parts = F.split(body, r"(?i)(?=<item[\s>/])")
    cut = responses.select(*rest, F.size(parts).alias("_n"), F.posexplode(parts).alias("_at", "_part")).where("_at > 0 OR _n = 1")
    ended = F.regexp_replace("_part", r"(?is)^(<item(?:\s[^>]*)?(?:/>|>.*?</item\s*>)).*$", "$1")
    return cut.select(*rest, F.when(F.col("_part").rlike(r"(?i)^<item[\s>/]"), ended).alias("xml"))


def read_rss_records(spark: SparkSession, path: str, symbol: str = r"([^/]+)\.xml$") -> DataFrame:
    """(path, symbol, xml) of every item of RSS files, as ``rss_records`` has them. A file, which is one response, must fit a task."""
    files = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rss_records(files.withColumn("symbol", F.upper(F.url_decode(F.regexp_extract("path", symbol, 1)))))


def read_rss_items(records: DataFrame, xml: str = "xml") -> DataFrame:
    """Items (title, link, pubDate) of their texts, and the ``reason`` why one gives no article, if so."""
    fields = ", ".join(f"{f.name} STRING" for f in RSS_ITEM)
    item = F.from_xml(xml, f"{fields}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    read = records.withColumn("item", item)
    reason = F.when(_absent(xml), "no items").when(F.col("item")[CORRUPT].isNotNull(), "malformed XML")
    reason = reason.when(rfc2822_timestamp(F.col("item.pubDate")).isNull(), "no usable time")
    return read.select(*records.columns, *(F.col(f"item.{f.name}").alias(f.name) for f in RSS_ITEM), reason.alias("reason"))


def rejected_rss(records: DataFrame, xml: str = "xml") -> DataFrame:
    """(symbol, …, record, reason) of items that give no article."""
    return read_rss_items(records, xml).where(F.col("reason").isNotNull()).select(*_carried(records), F.col(xml).alias("record"), "reason")


def parse_rss_items(items: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Articles from RSS items (``title, link, pubDate`` and ``symbol``) of ``start`` to the end of ``end``.

    A bound of None is open; items without a usable date are in no range.
    """
    published = F.col("published_at")
    within = published.isNotNull()
    if start is not None:
        within = within & (published >= F.lit(start).cast("timestamp"))
    if end is not None:
        within = within & (published <= F.lit(f"{end} 23:59:59").cast("timestamp"))
    return items.select(
        F.coalesce("title", F.lit("")).alias("headline"),
        rfc2822_timestamp(F.col("pubDate")).alias("published_at"),
        F.lit(RSS_SOURCE).alias("source"),
        F.col("link").alias("url"),
        "symbol",
    ).where(within)


def prefer_source(primary: DataFrame, fallback: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """All of ``primary``, and of ``fallback`` the rows whose key has nothing in ``primary``."""
    served = primary.select(*keys).distinct()
    return primary.unionByName(fallback.join(served, list(keys), "left_anti"))


def parse_fundamentals_json(responses: DataFrame, now: Column, body: str = "body") -> DataFrame:
    """Raw metrics from JSON objects (``symbol, body``); absent keys are null, ``as_of`` is today's date."""
    info = F.from_json(body, "MAP<STRING, STRING>")
    return responses.withColumn("info", info).select(
        "symbol",
        *(F.try_element_at("info", F.lit(key)).alias(name) for key, name in FUNDAMENTAL_KEYS.items()),
        iso_day(now.cast("timestamp")).alias("as_of"),
        *(c for c in ("provider",) if c in responses.columns),
    )


def rejected_fundamentals(responses: DataFrame, body: str = "body") -> DataFrame:
    """(symbol, …, record, reason) of responses that are no JSON object: ``parse_fundamentals_json`` knows only their symbol."""
    info = F.from_json(body, "MAP<STRING, STRING>")
    reason = F.when(_absent(body), "no body").when(info.isNull(), "malformed JSON")
    return responses.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*_carried(responses), F.col(body).alias("record"), "reason")


def series_dimension(spark: SparkSession, ids: Mapping[str, str] = MACRO_SERIES_IDS) -> DataFrame:
    return spark.createDataFrame(list(ids.items()), "series STRING, series_id STRING")


def name_macro_series(raw: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Macro points with the series' own name; points without a value and unknown ids are left out.

    The default dimension is a literal list of four rows and is broadcast; a given one is left to
    Spark's own size check.
    """
    names = F.broadcast(series_dimension(raw.sparkSession)) if dimension is None else dimension
    return (
        raw.dropna(subset=["value"])
        .join(names, "series_id")
        .select(F.col("date"), F.upper("series").alias("series"), F.col("value"))
    )


def unknown_macro_series(raw: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Points per upstream id that has no name."""
    names = F.broadcast(series_dimension(raw.sparkSession)) if dimension is None else dimension
    return raw.join(names, "series_id", "left_anti").groupBy("series_id").agg(F.count("*").alias("n"))
