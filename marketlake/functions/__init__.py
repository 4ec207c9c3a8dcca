"""Column functions: times, numbers, text, dataset keys and freshness."""

from marketlake.functions.keys import (
    PROVIDER_DEFAULTS,
    dataset_hash,
    date_tag,
    default_provider,
    storage_uri,
)
from marketlake.functions.freshness import is_intraday, ttl_seconds
from marketlake.functions.numbers import abs_pct_change, count_if, nan_to_null, to_double, safe_double
from marketlake.functions.text import is_blank
from marketlake.functions.times import (
    as_of_timestamp,
    iso_created_at,
    iso_day,
    iso_seconds,
    iso_seconds_z,
    iso_z_timestamp,
    rfc2822_timestamp,
    to_utc,
    utc_timestamp,
)

__all__ = [
    "PROVIDER_DEFAULTS", "dataset_hash", "date_tag", "default_provider", "storage_uri",
    "is_intraday", "ttl_seconds",
    "abs_pct_change", "count_if", "nan_to_null", "to_double", "safe_double",
    "is_blank",
    "as_of_timestamp", "iso_created_at", "iso_day", "iso_seconds", "iso_seconds_z", "iso_z_timestamp",
    "rfc2822_timestamp", "to_utc", "utc_timestamp",
]
