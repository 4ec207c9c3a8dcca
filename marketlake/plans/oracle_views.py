"""The shapes of :mod:`marketlake.plans.views` in SQL, as common table expressions for the oracles."""

from __future__ import annotations

_HASH = (
    "sha256('{{\"data_type\": \"{data_type}\", \"end\": \"2024-01-31\", \"provider\": \"{provider}\"{series}, "
    "\"start\": \"2024-01-01\"{symbol}{timeframe}}}')"
)


def _hash(data_type: str, provider: str, symbol: str = "", timeframe: str = "", series: str = "") -> str:
    """SQL of the dataset hash; the last three are SQL expressions."""

    def member(name: str, expression: str) -> str:
        return f", \"{name}\": \"' || {expression} || '\"" if expression else ""

    return _HASH.format(
        data_type=data_type, provider=provider, series=member("series", series),
        symbol=member("symbol", symbol), timeframe=member("timeframe", timeframe),
    )


_PUBLISHED = "TIMESTAMP '2024-01-01' + to_hours(doc_id)"

VIEWS = {
    "ticks": "SELECT 'S' || (user_id % 20) AS symbol, ts, event_id AS seq, value AS price FROM events",
    "bars_1d": """
        SELECT symbol, date_trunc('day', ts) AS timestamp, first(price ORDER BY ts, seq) AS open, max(price) AS high,
               min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM ticks GROUP BY ALL""",
    "bars_1h": """
        SELECT symbol, date_trunc('hour', ts) AS timestamp, first(price ORDER BY ts, seq) AS open, max(price) AS high,
               min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM ticks GROUP BY ALL""",
    "typed_bars": """
        SELECT 'S' || (user_id % 20) AS symbol, date_trunc('hour', ts) AS timestamp, event_id AS seq, value AS open,
               CASE WHEN event_id % 97 = 0 THEN value - 1 ELSE value + 1 END AS high,
               CASE WHEN event_id % 97 = 0 THEN value + 1 ELSE value - 1 END AS low,
               CASE WHEN event_id % 89 = 0 THEN value + 10 ELSE value END AS close,
               CASE WHEN event_id % 53 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) END AS volume
        FROM events WHERE event_id % 101 <> 0""",
    "canonical_bars": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol, timestamp ORDER BY seq) AS rn FROM typed_bars
        ) WHERE rn = 1""",
    "news": f"""
        SELECT text AS headline, {_PUBLISHED} AS published_at, source,
               'https://news.example/' || doc_id AS url, upper(lang) AS symbol
        FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 11 <> 0""",
    "fundamentals": """
        SELECT c_name AS symbol, o_orderdate AS as_of, o_totalprice AS market_cap, c_acctbal AS eps, o_orderkey AS seq
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "macro": """
        SELECT date_trunc('month', o_orderdate) AS date, upper(o_orderpriority) AS series, max(o_totalprice) AS value
        FROM orders GROUP BY ALL""",
    "attempts": """
        SELECT 'P' || (user_id % 3) AS provider,
               CASE user_id % 4 WHEN 0 THEN 'ohlcv' WHEN 1 THEN 'news' WHEN 2 THEN 'fundamentals' ELSE 'macro' END AS data_type,
               'S' || (user_id % 20) AS symbol,
               CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS status,
               CASE WHEN event_type <> 'purchase' THEN event_type END AS error, ts AS completed_at, event_id AS log_id
        FROM events""",
    "registry": f"""
        SELECT 'yahoo' AS provider, 'ohlcv' AS data_type, symbol, timeframe, NULL AS series, n AS rows, 9 AS columns,
               n_errors = 0 AS quality_passed, created_at, {_hash('ohlcv', 'yahoo', 'symbol', 'timeframe')} AS hash,
               's3://lake/datasets/ohlcv/' || symbol || '/' || timeframe || '/2024/' || symbol || '_' || timeframe
                   || '_20240101_' AS stem
        FROM (SELECT 'S' || user_id AS symbol, CASE WHEN user_id % 2 = 0 THEN '1d' ELSE '1h' END AS timeframe,
                     count(*) AS n, max(ts) AS created_at, count(*) FILTER (WHERE event_type = 'error') AS n_errors
              FROM events GROUP BY user_id, CAST(ts AS DATE))
        UNION ALL
        SELECT 'news', 'news', symbol, NULL, NULL, n, 6, true, TIMESTAMP '2024-01-01' + to_hours(last % 720),
               {_hash('news', 'news', 'symbol')},
               's3://lake/datasets/news/' || symbol || '/2024/' || symbol || '_news_20240101_'
        FROM (SELECT upper(lang || '-' || source) AS symbol, count(*) AS n, max(doc_id) AS last
              FROM documents GROUP BY lang, source)
        UNION ALL
        SELECT 'fred', 'macro', NULL, NULL, series, n, 4, true, TIMESTAMP '2024-01-01' + to_hours(n % 720),
               {_hash('macro', 'fred', series='series')},
               's3://lake/datasets/macro/' || series || '/' || series || '_2024_'
        FROM (SELECT upper(o_orderpriority) AS series, count(*) AS n FROM orders GROUP BY o_orderpriority)""",
    "stored_registry": "SELECT * EXCLUDE (stem), stem || substr(hash, 1, 8) || '.parquet' AS storage_uri FROM registry",
    "latest": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created_at DESC) AS rn FROM stored_registry
        ) WHERE rn = 1""",
    "symbols": "SELECT DISTINCT upper('s' || user_id) AS symbol FROM events",
    "requests": f"""
        SELECT 'ohlcv' AS data_type, 'yahoo' AS provider, symbol, timeframe, NULL AS series,
               {_hash('ohlcv', 'yahoo', 'symbol', 'timeframe')} AS hash
        FROM symbols CROSS JOIN (VALUES ('1d'), ('1h')) AS t(timeframe)
        UNION ALL
        SELECT 'news', 'news', symbol, NULL, NULL, {_hash('news', 'news', 'symbol')} FROM symbols
        UNION ALL
        SELECT 'macro', 'fred', NULL, NULL, series, {_hash('macro', 'fred', series='series')}
        FROM (VALUES ('CPI'), ('FED_FUNDS_RATE'), ('GDP_GROWTH'), ('UNEMPLOYMENT')) AS t(series)""",
}

# Which other views a view reads.
_NEEDS = {
    "bars_1d": ["ticks"],
    "bars_1h": ["ticks"],
    "canonical_bars": ["typed_bars"],
    "stored_registry": ["registry"],
    "latest": ["stored_registry"],
    "requests": ["symbols"],
}


def over(views: list[str], select: str) -> str:
    """The statement with the named views, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + select
