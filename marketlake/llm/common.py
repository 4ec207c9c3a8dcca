"""What the operators of this package share: tables, cut lineage, byte-wise words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.session import shared_folder

#: ASCII white space as the word rules of this package name it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the cluster's shared folder: lineage ends here.

    A lost executor costs the tasks it ran, not the stages before, and nothing is computed twice.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that Spark hands to a Python worker at a time: rows here hold whole texts, which a count of rows doesn't bound.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with Arrow batches bounded in bytes; the session keeps that bound."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most_bytes`` of a binary column, so that long texts don't add up."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)).cast("int64"), 0))
        start, ends = 0, ends.to_numpy(zero_copy_only=False)
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8_bytes(column: str = "text"):
    """A text column as bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))
