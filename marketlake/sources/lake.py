"""Reading the stored tables back, now or as of an earlier moment, and keeping their runs in order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marketlake import schemas
from marketlake.operators.catalog import latest_version
from marketlake.operators.resample import arrival_order
from marketlake.sinks.store import (
    BUCKETS,
    CATALOG_TABLES,
    folder_name,
    in_force,
    moved,
    partition_columns,
    run_changes,
    run_of,
    run_path,
    stored_layout,
    symbol_bucket,
    table_path,
)


def stored_schema(data_type: str, layout: str = "symbol") -> T.StructType:
    """Canonical columns, the version columns, and the folder columns that are not among them."""
    schema = T.StructType(list(schemas.CANONICAL[data_type].fields))
    schema = schema.add("hash", "string").add("created_at", "timestamp")
    for name, kind in (("year", "integer"), ("symbol_bucket", "integer"), ("run", "string")):
        if name in partition_columns(data_type, layout):
            schema = schema.add(name, kind)
    return schema


def snapshots(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """The moments as of which a table can be read: (made_at, commit, n_added, n_replaced)."""
    changes = run_changes(spark, root)
    if changes is None:
        return schemas.empty(spark, schemas.struct(made_at="timestamp", commit="string", n_added="long", n_replaced="long"))
    count = lambda state: F.count(F.when(F.col("state") == state, 1))
    own = changes.where(F.col("data_type") == data_type).groupBy("made_at", "commit")
    return own.agg(count("added").alias("n_added"), count("replaced").alias("n_replaced"))


def runs_in_force(spark: SparkSession, root: str, data_type: str, as_of: datetime | None = None) -> DataFrame:
    """(run) of the runs that make up a table, now or as of a moment."""
    changes = run_changes(spark, root, as_of)
    return schemas.empty(spark, schemas.struct(run="string")) if changes is None else in_force(changes, data_type)


def read_canonical(
    spark: SparkSession,
    root: str,
    data_type: str,
    names: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    run: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """A stored table; symbols (or series), range and run select its folders.

    Only runs in force are read, as of ``as_of`` where that is given: neither those that were replaced nor what a run that never
    committed left behind. A table without any commit is read whole. The layout is the one the table was written with. The
    time filter itself stays with the range reads: here ``start`` and ``end`` only prune years. With ``run``, nothing but
    that run's folder is listed, committed or not; a run that stored nothing is empty.
    """
    layout, buckets = stored_layout(spark, root, data_type) or ("symbol", BUCKETS)
    reader = spark.read.schema(stored_schema(data_type, layout)).option("basePath", table_path(root, data_type))
    try:
        df = reader.parquet(table_path(root, data_type) if run is None else run_path(root, data_type, run))
    except AnalysisException as e:
        if run is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty(spark, stored_schema(data_type, layout))
    changes = run_changes(spark, root, as_of) if run is None else None
    if changes is not None:
        df = df.join(in_force(changes, data_type), "run", "left_semi").select(*df.columns)
    folders = partition_columns(data_type, layout)
    key = "series" if data_type == "macro" else "symbol"
    if names is not None:
        wanted = [n.upper() for n in names]
        df = df.where(F.col(key).isin(wanted))
        if "symbol_bucket" in folders:
            df = df.where(F.col("symbol_bucket").isin(*(symbol_bucket(F.lit(n), buckets) for n in wanted)))
    if "year" in folders and start is not None:
        df = df.where(F.col("year") >= int(start[:4]))
    if "year" in folders and end is not None:
        df = df.where(F.col("year") <= int(end[:4]))
    return df


def live_rows(stored: DataFrame, registry: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """Rows of the version in force of every dataset. The join holds the run, a folder: other runs' files are pruned."""
    live = latest_version(registry, invalidated).select("hash", "created_at", run_of(F.col("storage_uri")).alias("run"))
    return stored.join(live, ["hash", "created_at", "run"], "left_semi")


def current_rows(stored: DataFrame, registry: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """What holds now: canonical columns, one row per (series, moment).

    Datasets of overlapping requests are all in force; where they tell of one moment, the newest version's row
    wins. An aggregate of fixed-width buffers for bars and macro points; news rows, which have no values but texts, are
    told apart by all of their columns.
    """
    rows = live_rows(stored, registry, invalidated)
    data_type = next(t for t, c in schemas.TIME_COLUMN.items() if c in stored.columns)
    names = schemas.CANONICAL[data_type].fieldNames()
    keys = names if data_type == "news" else [*schemas.SERIES_KEYS[data_type], schemas.TIME_COLUMN[data_type]]
    values = [c for c in names if c not in keys]
    if not values:
        return rows.select(*names).distinct()
    ordered = rows.withColumn("_hash", F.xxhash64("hash")).withColumn("_age", arrival_order(F.col("created_at"), "_hash"))
    return ordered.groupBy(*keys).agg(*(F.max_by(c, "_age").alias(c) for c in values)).select(*names)


def read_catalog(spark: SparkSession, root: str, table: str, run: str | None = None, as_of: datetime | None = None) -> DataFrame:
    """``registry``, ``ingestion_log``, ``events`` or ``tombstones``; empty where nothing was written.

    The registry says where every version is now: a run that was folded into another is named by that one. ``as_of`` gives
    the registry, and the places, of an earlier moment.
    """
    schema = T.StructType(list(CATALOG_TABLES[table].fields)).add("run", "string")
    reader = spark.read.schema(schema).option("basePath", table_path(root, table))
    try:
        df = reader.parquet(table_path(root, table) if run is None else run_path(root, table, run))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty(spark, CATALOG_TABLES[table])
    df = df.drop("run")
    if table != "registry":
        return df
    if as_of is not None:
        df = df.where(F.col("created_at") <= F.lit(as_of).cast("timestamp"))
    changes = run_changes(spark, root, as_of)
    return df if changes is None else relocated(df, changes)


def lookup_hashes(spark: SparkSession, root: str, hashes: Sequence[str], table: str = "registry") -> DataFrame:
    """The rows of a catalog table for a few hashes. The condition reaches the scan, which passes over row groups whose bloom filter
    has none of them."""
    return read_catalog(spark, root, table).where(F.col("hash").isin(*hashes))


def stored_coverage(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """The day sets of a table's versions in force, as the runs that kept them stored them."""
    live = latest_version(read_catalog(spark, root, "registry"), read_catalog(spark, root, "tombstones")).select("hash", "created_at")
    return read_catalog(spark, root, "coverage").where(F.col("data_type") == data_type).join(live, ["hash", "created_at"], "left_semi")


def relocated(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry rows with the places their versions moved to."""
    old, own = run_of(F.col("storage_uri")), moved(changes).withColumnRenamed("run", "_run")
    rows = registry.withColumn("_run", old).join(own, ["data_type", "_run"], "left")
    place = F.replace("storage_uri", F.concat(F.lit("/run="), folder_name(F.col("_run")), F.lit("/")), F.concat(F.lit("/run="), folder_name(F.col("by")), F.lit("/")))
    return rows.withColumn("storage_uri", F.when(F.col("by").isNull(), F.col("storage_uri")).otherwise(place)).select(*registry.columns)


def _place(path: Column) -> Column:
    """A series' folder below ``datasets``, whatever the scheme and the years: what a location and its files share."""
    return F.regexp_replace(F.regexp_extract(path, "/datasets/(.*)$", 1), "(/year=[^/]*)?(/[^/=]*)?$", "")


def reconcile(registry: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registered versions without files, folders (``place``) with files that nobody registered).

    ``files`` is a listing as ``stored_files`` gives it: no file is opened.
    """
    on_disk = files.select(_place(F.col("path")).alias("place")).distinct()
    known = registry.withColumn("place", _place(F.col("storage_uri")))
    return known.join(on_disk, "place", "left_anti").drop("place"), on_disk.join(known, "place", "left_anti")


def stored_files(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """Path, size and time of a table's files; the listing does not read their content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(table_path(root, data_type))
        .select("path", "length", "modificationTime")
    )
