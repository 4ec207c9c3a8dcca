"""The feed of the registered provider queries: bounded batches, places in the feed by event, whatever the order of the file."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from marketlake.operators.normalize import normalize_bars
from marketlake.plans import provider_queries
from marketlake.plans.provider_queries import EventsProvider
from marketlake.sources import providers


def test_batches_are_bounded_and_numbered_by_event(spark, folder, monkeypatch):
    n = 20_000
    ids = np.random.default_rng(3).permutation(n)
    at = [datetime(2024, 1, 1) + timedelta(seconds=300 * int(i)) for i in ids]
    events = pa.table({"event_id": ids, "ts": pa.array(at, pa.timestamp("us")), "user_id": ids % 40, "value": ids / 7})
    path = f"{folder}/events.parquet"
    pq.write_table(events, path, row_group_size=4_000)
    monkeypatch.setattr(provider_queries, "_READ_ROWS", 1_000, raising=False)

    feed = EventsProvider({"path": path})
    downloads = providers._Downloads(feed, "ohlcv", "1h")
    batches = list(downloads.batches("S3", date(2024, 1, 2), date(2024, 1, 20)))
    assert max(b.num_rows for b in batches) <= 1_000 / 10
    wanted = [int(i) for i in ids if i % 20 == 3 and 288 <= i < 20 * 288]
    assert [s for b in batches for s in b.column("seq").to_pylist()] == wanted
    assert list(feed.symbols()) == [f"S{k}" for k in sorted(range(20))]
    assert feed.newest() == (datetime(2024, 1, 1) + timedelta(seconds=300 * (n - 1))).date() - timedelta(days=1)

    providers.register_provider(spark, EventsProvider)
    raw = providers.read_provider(spark, "ohlcv", ["S3"], "2024-01-02", "2024-01-20", "1h", "events_feed", path=path)
    first = {}
    for i in sorted(w for w in wanted if w % 101):
        first.setdefault(i // 12, i)
    assert sorted(r.low for r in normalize_bars(raw).collect()) == sorted(i / 7 + (1 if i % 97 == 0 else -1) for i in first.values())
