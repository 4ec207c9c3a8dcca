"""Dataset keys: request hash, date tag and storage location."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which provider serves a data type when the request names none.
PROVIDER_DEFAULTS = {
    "ohlcv": "yahoo",
    "news": "news",
    "fundamentals": "yahoo",
    "macro": "fred",
}


def default_provider(data_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in PROVIDER_DEFAULTS.items() for x in pair))[data_type]


def _json_string(c: Column) -> Column:
    """The value as a JSON string literal. Two replacements: ``to_json`` per row costs far more."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _ascii(json: Column) -> Column:
    """JSON text with every character beyond ASCII as ``\\uXXXX``, a surrogate pair where it needs two."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        return F.when(code < 0x80, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(json, ""), escaped), "")).otherwise(json)


def dataset_hash(
    data_type: Column,
    provider: Column,
    symbol: Column | None = None,
    timeframe: Column | None = None,
    start: Column | None = None,
    end: Column | None = None,
    series: Column | None = None,
) -> Column:
    """SHA-256 (hex) of the request as key-sorted JSON; an absent or null parameter has no key.

    Values are free of control characters: symbols, series and dates.
    """
    params = {
        "data_type": data_type, "provider": provider, "symbol": symbol, "timeframe": timeframe,
        "start": start, "end": end, "series": series,
    }
    members = [
        F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), _json_string(value.cast("string"))))
        for name, value in sorted(params.items())
        if value is not None
    ]
    return F.sha2(_ascii(F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))), 256)


def date_tag(day: Column) -> Column:
    """``2024-01-02`` to ``20240102``."""
    return F.regexp_replace(day, "-", "")


def storage_uri(
    root: str,
    data_type: Column,
    symbol: Column,
    timeframe: Column,
    series: Column,
    day: Column,
    hash_: Column,
) -> Column:
    """Location of a dataset: its folder by data type, then name, date tag and the hash's first eight."""
    tag = date_tag(day)
    year = F.substring(tag, 1, 4)
    suffix = F.concat(F.lit("_"), F.substring(hash_, 1, 8), F.lit(".parquet"))
    base = F.lit(root.rstrip("/") + "/datasets/")
    # The folder and file name pattern per data type.
    return (
        F.when(data_type == "ohlcv", F.concat(
            base, F.lit("ohlcv/"), symbol, F.lit("/"), timeframe, F.lit("/"), year, F.lit("/"),
            symbol, F.lit("_"), timeframe, F.lit("_"), tag, suffix))
        .when(data_type == "news", F.concat(
            base, F.lit("news/"), symbol, F.lit("/"), year, F.lit("/"),
            symbol, F.lit("_news_"), tag, suffix))
        .when(data_type == "fundamentals", F.concat(
            base, F.lit("fundamentals/"), symbol, F.lit("/"),
            symbol, F.lit("_fundamentals_"), tag, suffix))
        .when(data_type == "macro", F.concat(
            base, F.lit("macro/"), series, F.lit("/"), series, F.lit("_"), year, suffix))
    )
