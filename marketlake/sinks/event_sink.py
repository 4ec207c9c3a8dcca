"""The event log as a streaming sink that takes every micro-batch once.

``foreachBatch`` leaves it to its function what a replayed batch does. This is a data source: its tasks write to files of their own under
a staging folder, the commit of a micro-batch moves them into the folder named after (application, batch), and an aborted one removes them.
A batch that comes again, after a failure or from a query that starts over, finds its folder and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from marketlake import schemas
from marketlake.sinks.store import table_path

NAME = "marketlake_events"


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _EventWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.app = options["path"].rstrip("/"), options["app"]

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = self._at()
        path, rows, writer = f"{root}/_staged/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        store.create_dir(f"{root}/_staged", recursive=True)
                        writer = pq.ParquetWriter(path, batch.schema, filesystem=store, compression="zstd")
                    writer.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return _Written(path if rows else "", rows)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        store, root = self._at()
        name = f"run={self.app}-{batchId:012d}"
        done = f"{root}/_committed/{name}.json"
        staged = [m.path for m in messages if m is not None and m.path]
        if store.get_file_info(done).type != fs.FileType.NotFound:
            self._drop(store, staged)
            return
        # Moves first, the mark last: a commit that broke off left a folder without a mark, which this one replaces.
        if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{name}")
        if staged:
            store.create_dir(f"{root}/{name}", recursive=True)
        for k, path in enumerate(sorted(staged)):
            store.move(path, f"{root}/{name}/part-{k:05d}.parquet")
        store.create_dir(f"{root}/_committed", recursive=True)
        with store.open_output_stream(done) as out:
            out.write(json.dumps({"files": len(staged), "rows": sum(m.rows for m in messages if m is not None)}).encode())

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        store, _ = self._at()
        self._drop(store, [m.path for m in messages if m is not None and m.path])

    @staticmethod
    def _drop(store: fs.FileSystem, paths: list[str]) -> None:
        for path in paths:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)


class EventSink(DataSource):
    """Options: ``path``, the folder of the event table, and ``app``, who writes: batch numbers count on under that name."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "event STRING, payload STRING, published_at TIMESTAMP"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _EventWriter(dict(self.options))


def append_events(events: DataFrame, root: str, app: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of events to the stored event log, each micro-batch once. ``app`` names the query: a query of the same name that
    starts over, with a new checkpoint, finds its first batches written."""
    spark = events.sparkSession
    spark.dataSource.register(EventSink)
    shaped = events.select(*(F.col(f.name).cast(f.dataType) for f in schemas.EVENTS))
    writer = shaped.writeStream.format(NAME).option("path", table_path(root, "events")).option("app", app)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed_batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch, files, rows) of every micro-batch that the sink has taken."""
    marks = spark.read.schema("files LONG, rows LONG").json(f"{table_path(root, 'events')}/_committed/*.json")
    return marks.select(F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)\.json$", 1).alias("batch"), "files", "rows")
