"""Registered queries on news, fundamentals and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.functions import iso_day, iso_seconds_z
from marketlake.operators import quality
from marketlake.operators.normalize import normalize_fundamentals, normalize_macro
from marketlake.operators.reads import get_macro, get_news, latest_fundamentals
from marketlake.plans import views
from marketlake.plans.oracle_views import over
from marketlake.sources import feeds


def _shown(news: DataFrame) -> DataFrame:
    return news.select(
        "headline", iso_seconds_z(F.col("published_at")).alias("published_at"), "source", "url", "symbol"
    )


def range_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_news(views.news(spark, sf_dir), None, "2024-01-03", "2024-01-25")


def news_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(feeds.parse_news_json(views.news_responses(spark, sf_dir)))


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.from_xml("xml", "title STRING, link STRING, pubDate STRING")
    items = views.rss_items(spark, sf_dir).select("symbol", item.alias("i")).select("symbol", "i.*")
    return _shown(feeds.parse_rss_items(items, "2024-01-02"))


def prefer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (symbol, source): the articles fit for delivery, or the raw ones where none is."""
    good = views.news(spark, sf_dir).where(F.length("headline") > 2000).select("symbol", "source", "url")
    every = views.raw_news(spark, sf_dir).select("symbol", "source", "url")
    return feeds.prefer_source(good, every, ["symbol", "source"])


def _check(field: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = views.raw_news(spark, sf_dir).withColumn("published_at", F.try_to_timestamp("published_at"))
        report = quality.check_news(raw, views.as_of()).where(F.col("field") == field)
        return report.select("symbol", "check", "n_bad", "passed", F.coalesce("message", F.lit("")).alias("message"))

    return query


def parse_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream JSON to canonical fundamentals; the snapshot's own time replaces today's date."""
    raw = views.raw_fundamentals(spark, sf_dir)
    parsed = feeds.parse_fundamentals_json(raw.withColumn("symbol", F.struct("symbol", "taken", "seq")), views.as_of())
    flat = parsed.withColumns({"as_of": F.col("symbol.taken"), "seq": F.col("symbol.seq"), "symbol": F.col("symbol.symbol")})
    return _snapshots(normalize_fundamentals(flat, views.as_of()))


def _snapshots(fundamentals: DataFrame) -> DataFrame:
    return fundamentals.select(
        "symbol", iso_day(F.col("as_of")).alias("as_of"), "market_cap", "eps",
        F.expr("pe_ratio is null and pb_ratio is null").alias("no_ratios"),
    )


def newest_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_fundamentals(views.fundamentals(spark, sf_dir), seq="seq")
    return rows.select("symbol", "as_of", "market_cap", "eps")


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = feeds.name_macro_series(views.raw_macro(spark, sf_dir))
    points = normalize_macro(named, provider="fred")
    return points.select(iso_day(F.col("date")).alias("date"), "series", "value", "provider")


def range_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_macro(views.macro(spark, sf_dir), None, "1996-01-01", "1999-12-01")


QUERIES = {
    "normalize_news": lambda spark, sf_dir: _shown(views.news(spark, sf_dir)),
    "range_news": range_news,
    "news_json": news_json,
    "rss_items": rss_items,
    "prefer_source": prefer_source,
    "check_future_news": _check("published_at"),
    "check_blank_headlines": _check("headline"),
    "normalize_fundamentals": parse_fundamentals,
    "latest_fundamentals": newest_fundamentals,
    "normalize_macro": macro_series,
    "macro_rejects": lambda spark, sf_dir: feeds.unknown_macro_series(views.raw_macro(spark, sf_dir)),
    "range_macro": range_macro,
}

_NEWS = "headline, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, source, url, symbol"
_PUBLISHED = "TIMESTAMP '2024-01-01' + to_hours(doc_id)"
_MONTHLY = """
    SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, max(o_totalprice) AS value, count(*) AS n
    FROM orders GROUP BY ALL"""


def _checked(check: str, bad: str, said: str) -> str:
    return f"""
        SELECT *, n_bad = 0 AS passed, CASE WHEN n_bad > 0 THEN '{check}: ' || n_bad || ' {said}' ELSE '' END AS message
        FROM (SELECT upper(lang) AS symbol, '{check}' AS "check", count(*) FILTER (WHERE {bad}) AS n_bad
              FROM documents GROUP BY upper(lang))"""


ORACLES = {
    "normalize_news": over(["news"], f"SELECT {_NEWS} FROM news"),
    "range_news": over(["news"], f"""
        SELECT {_NEWS} FROM news
        WHERE published_at >= TIMESTAMP '2024-01-03' AND published_at <= TIMESTAMP '2024-01-25 23:59:59'"""),
    "news_json": f"""
        SELECT {_NEWS} FROM (
            SELECT CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS headline, {_PUBLISHED} AS published_at, source,
                   'https://news.example/' || doc_id AS url, upper(lang) AS symbol
            FROM documents WHERE doc_id % 11 <> 0)""",
    "rss_items": f"""
        SELECT text AS headline, strftime({_PUBLISHED}, '%Y-%m-%dT%H:%M:%SZ') AS published_at, 'Yahoo Finance' AS source,
               'https://news.example/' || doc_id AS url, upper(lang) AS symbol
        FROM documents
        WHERE {_PUBLISHED} >= TIMESTAMP '2024-01-02'""",
    "prefer_source": over(["news"], """
        , good AS (SELECT symbol, source, url FROM news WHERE length(headline) > 2000)
        SELECT * FROM good
        UNION ALL
        SELECT upper(lang), source, 'https://news.example/' || doc_id FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.symbol = upper(d.lang) AND g.source = d.source)"""),
    "check_future_news": _checked(
        "check_future_timestamps", f"doc_id % 11 <> 0 AND {_PUBLISHED} > TIMESTAMP '2024-01-31'",
        "articles with future published_at"),
    "check_blank_headlines": _checked(
        "check_empty_headlines", "doc_id % 13 = 0", "empty headlines (should have been filtered)"),
    "normalize_fundamentals": """
        SELECT c_name AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS as_of,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS market_cap, c_acctbal AS eps,
               true AS no_ratios
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "latest_fundamentals": over(["fundamentals"], """
        SELECT symbol, strftime(as_of, '%Y-%m-%d') AS as_of, market_cap, eps
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC, seq DESC) AS rn FROM fundamentals)
        WHERE rn = 1"""),
    "normalize_macro": f"""
        SELECT strftime(month, '%Y-%m-%d') AS date,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CPI' WHEN '2' THEN 'FED_FUNDS_RATE'
                    WHEN '3' THEN 'GDP_GROWTH' ELSE 'UNEMPLOYMENT' END AS series, value, 'fred' AS provider
        FROM ({_MONTHLY}) WHERE o_orderpriority <> '5-LOW' AND n % 13 <> 0""",
    "macro_rejects": f"""
        SELECT 'NO_SUCH_ID' AS series_id, count(*) AS n FROM ({_MONTHLY}) WHERE o_orderpriority = '5-LOW'""",
    "range_macro": over(["macro"], """
        SELECT strftime(date, '%Y-%m-%d') AS date, series, value FROM macro
        WHERE date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '1999-12-01'"""),
}
