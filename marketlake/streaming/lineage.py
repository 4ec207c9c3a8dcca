"""Lineage as a stream: every log row with its dataset version, whichever of the two comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: What a log row gets of its version.
_OF_DATASET = ("storage_uri", "rows", "quality_passed")


def lineage_stream(log: DataFrame, registry: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The columns of ``log`` with storage_uri, rows and quality_passed of its dataset version (hash, created_at), append mode.

    A log row with a version comes out once with it, as soon as both are there. One whose version does not come, or was
    removed, comes out with nulls once the watermark, ``delay`` behind the newer rows of the slower side, has passed its time: until then
    either side waits in state, and no longer. A failed attempt, which names no version, passes at once.
    """
    named = log.where("hash is not null and created_at is not null").withWatermark("created_at", delay)
    version = registry.select(F.col("hash").alias("_hash"), F.col("created_at").alias("_created_at"), *_OF_DATASET).withWatermark("_created_at", delay)
    # The time is part of the key, which bounds how long a row can wait for the other side.
    same = (F.col("hash") == F.col("_hash")) & (F.col("created_at") == F.col("_created_at"))
    joined = named.join(version, same, "leftOuter").select(*log.columns, *_OF_DATASET)
    nameless = log.where("hash is null or created_at is null")
    of = {c: registry.schema[c].dataType for c in _OF_DATASET}
    return joined.unionByName(nameless.select(*log.columns, *(F.lit(None).cast(t).alias(c) for c, t in of.items())))
