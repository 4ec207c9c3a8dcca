"""Writing canonical and catalog tables.

Every write belongs to a run, the outermost folder of every table. Another run's data is never replaced, a retry of the same run
replaces just its own files, and reading a run lists that run's folder only.

Which runs make up a table is told by its commits: small files, each written as one, that add runs or replace them by another. A
run that was not committed is not read; ``compact`` writes many runs as one and swaps them in one commit, and the old folders
stay readable as of an earlier moment until ``expire`` removes them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marketlake import schemas
from marketlake.functions import dataset_hash

CATALOG_TABLES = {
    "registry": schemas.REGISTRY,
    "ingestion_log": schemas.INGESTION_LOG,
    "events": schemas.EVENTS,
    "tombstones": schemas.TOMBSTONES,
    "rejects": schemas.REJECTS,
    "coverage": schemas.COVERAGE,
}

# Random keys that are looked up one by one: statistics don't help there, a bloom filter per row group does. A dictionary
# of values that don't repeat would only keep Parquet from writing one.
_LOOKED_UP = {"parquet.bloom.filter.enabled#hash": "true", "parquet.enable.dictionary#hash": "false"}

#: Symbol buckets of the "bucket" layout.
BUCKETS = 256

# Folder levels of the stored tables below the run, outermost first.
_FOLDERS = {
    "ohlcv": ("symbol", "timeframe", "year"),
    "news": ("symbol", "year"),
    "fundamentals": ("symbol",),
    "macro": ("series",),
}


def table_path(root: str, table: str) -> str:
    folder = "catalog" if table in CATALOG_TABLES else "datasets"
    return f"{root.rstrip('/')}/{folder}/{table}"


def partition_columns(data_type: str, layout: str = "symbol") -> tuple[str, ...]:
    """Folder columns. The "bucket" layout is for more symbols than a table should have folders."""
    if layout not in ("symbol", "bucket"):
        raise ValueError(f"layout must be 'symbol' or 'bucket', not {layout!r}")
    swap = {"symbol": "symbol_bucket"} if layout == "bucket" else {}
    return ("run", *(swap.get(c, c) for c in _FOLDERS[data_type]))


def _layout_path(root: str, data_type: str) -> str:
    return f"{root.rstrip('/')}/catalog/layout/{data_type}"


def stored_layout(spark: SparkSession, root: str, data_type: str) -> tuple[str, int] | None:
    """(layout, buckets) of a stored table as its first writer noted them; None before that."""
    try:
        row = spark.read.schema("layout string, buckets int").parquet(_layout_path(root, data_type)).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and (row.layout, row.buckets)


def _note_layout(spark: SparkSession, root: str, data_type: str, layout: str, buckets: int) -> None:
    noted = stored_layout(spark, root, data_type)
    if noted is None:
        rows = spark.createDataFrame([(layout, buckets)], "layout string, buckets int")
        rows.coalesce(1).write.mode("overwrite").parquet(_layout_path(root, data_type))
    elif noted != (layout, buckets):
        raise ValueError(f"the table is stored with layout {noted[0]!r} and {noted[1]} buckets")


def symbol_bucket(symbol: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def with_version(
    df: DataFrame, data_type: str, created_at: Column, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Add the version columns ``hash`` and ``created_at``, as the registry will hold them."""
    part = {c: F.col(c) if c in schemas.SERIES_KEYS[data_type] else F.lit(None) for c in ("symbol", "timeframe", "series")}
    key = dataset_hash(
        F.lit(data_type), F.col("provider"), part["symbol"], part["timeframe"],
        F.lit(start).cast("string"), F.lit(end).cast("string"), part["series"],
    )
    return df.withColumns({"hash": key, "created_at": created_at.cast("timestamp")})


# Characters that Spark escapes in folder names, the escape sign first.
_ESCAPED = "%\"#'*/:=?\\{[]^"


def folder_name(value: Column) -> Column:
    for c in _ESCAPED:
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def run_path(root: str, table: str, run: str) -> str:
    """The folder of one run of a table."""
    return f"{table_path(root, table)}/run={''.join(f'%{ord(c):02X}' if c in _ESCAPED else c for c in run)}"


def run_of(location: Column) -> Column:
    """The run in a location as ``stored_folder`` writes it."""
    name = F.regexp_extract(location, "/run=([^/]+)", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def stored_folder(data_type: str, root: str, run: str, layout: str = "symbol", buckets: int = BUCKETS) -> Column:
    """Where a run stores a series, as a path that ``spark.read.parquet`` takes (``year=*`` for all years)."""
    values = {"year": F.lit("*"), "run": folder_name(F.lit(run)), "symbol_bucket": symbol_bucket(F.col("symbol"), buckets).cast("string")}
    levels = [
        F.concat(F.lit(f"{c}="), values[c] if c in values else folder_name(F.col(c)))
        for c in partition_columns(data_type, layout)
    ]
    return F.concat_ws("/", F.lit(table_path(root, data_type)), *levels)


def write_canonical(
    df: DataFrame,
    data_type: str,
    root: str,
    run: str,
    created_at: Column,
    start: str | None = None,
    end: str | None = None,
    layout: str = "symbol",
    buckets: int = BUCKETS,
) -> None:
    """Store a canonical table as zstd Parquet, foldered, in time order inside each file.

    ``rebalance`` lets adaptive execution merge small folders and split a hot one over several tasks.
    The version columns are added after that shuffle, so that it does not carry them.
    """
    ts = schemas.TIME_COLUMN[data_type]
    folders = partition_columns(data_type, layout)
    _note_layout(df.sparkSession, root, data_type, layout, buckets)
    out = df
    if "year" in folders:
        out = out.withColumn("year", F.year(ts))
    if "symbol_bucket" in folders:
        out = out.withColumn("symbol_bucket", symbol_bucket(F.col("symbol"), buckets))
    out = out.hint("rebalance", *(c for c in folders if c != "run"))
    out = with_version(out, data_type, created_at, start, end).withColumn("run", F.lit(run))
    _write_in_order(out, data_type, root, folders)


def _write_in_order(out: DataFrame, data_type: str, root: str, folders: tuple[str, ...]) -> None:
    """The rows as foldered zstd Parquet, in time order inside each file."""
    # The writer keeps this order only where it sees it start with the folder columns as they are. A constant among them
    # (the run, a feed's one timeframe) would drop out of the sort, and a nullable text be converted after it.
    for c in folders:
        if out.schema[c].dataType.typeName() == "string":
            out = out.withColumn(c, F.coalesce(F.when(F.monotonically_increasing_id() >= 0, F.col(c)), F.lit("")))
    inside = [c for c in schemas.SERIES_KEYS[data_type] if c not in folders]
    (
        out.sortWithinPartitions(*folders, *inside, schemas.TIME_COLUMN[data_type])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*folders)
        .parquet(table_path(root, data_type))
    )


def write_catalog(df: DataFrame, table: str, root: str, run: str, **options: str) -> None:
    """Add rows to a catalog table. ``options`` are Parquet's, besides a bloom filter on the hash where there is one."""
    schema = CATALOG_TABLES[table]
    looked_up = _LOOKED_UP if "hash" in schema.fieldNames() else {}
    (
        schemas.conform(df, schema)
        .withColumn("run", F.lit(run))
        .hint("rebalance")
        .write.mode("overwrite")
        .options(**looked_up, **options)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("run")
        .parquet(table_path(root, table))
    )


def run_changes_path(root: str) -> str:
    return f"{root.rstrip('/')}/catalog/runs"


def run_changes(spark: SparkSession, root: str, as_of: datetime | None = None) -> DataFrame | None:
    """(data_type, commit, run, state, by, made_at) of the commits until ``as_of``; None where nothing was ever committed."""
    schema = T.StructType(list(schemas.RUN_CHANGES.fields)).add("data_type", "string").add("commit", "string")
    try:
        changes = spark.read.schema(schema).parquet(run_changes_path(root))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return changes if as_of is None else changes.where(F.col("made_at") <= F.lit(as_of).cast("timestamp"))


def in_force(changes: DataFrame, data_type: str) -> DataFrame:
    """(run) of the runs that a table's changes leave. A run's name is used once, so a replaced one never comes back."""
    own = changes.where(F.col("data_type") == data_type)
    return own.groupBy("run").agg(F.bool_or(F.col("state") == "replaced").alias("gone")).where("not gone").select("run")


def commit_runs(
    spark: SparkSession, data_type: str, root: str, commit: str, made_at: datetime, added: str, replaced: DataFrame | None = None
) -> None:
    """Make ``added`` part of a table, and ``replaced`` (run) no longer, at once: one file that is there or is not.

    A commit is named, so that a retry replaces its own. Commits that only add never conflict; one process compacts a table.
    """
    rows = spark.range(1).select(F.lit(added).alias("run"), F.lit("added").alias("state"))
    rows = rows.withColumn("by", F.lit(None).cast("string"))
    if replaced is not None:
        gone = replaced.select("run", F.lit("replaced").alias("state"), F.lit(added).alias("by"))
        rows = rows.unionByName(gone)
    rows = rows.withColumns({"made_at": F.lit(made_at).cast("timestamp"), "data_type": F.lit(data_type), "commit": F.lit(commit)})
    (
        rows.coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("data_type", "commit")
        .parquet(run_changes_path(root))
    )


def write_compacted(rows: DataFrame, data_type: str, root: str, into: str) -> None:
    """Store rows of any number of runs, with their hash and created_at, as the one run ``into``: files of about the advisory
    size, in the order and folders of every other write."""
    layout, buckets = stored_layout(rows.sparkSession, root, data_type) or ("symbol", BUCKETS)
    folders = partition_columns(data_type, layout)
    out = rows.withColumn("run", F.lit(into))
    if "year" in folders:
        out = out.withColumn("year", F.year(schemas.TIME_COLUMN[data_type]))
    if "symbol_bucket" in folders:
        out = out.withColumn("symbol_bucket", symbol_bucket(F.col("symbol"), buckets))
    _write_in_order(out.hint("rebalance", *(c for c in folders if c != "run")), data_type, root, folders)


def remove_run(spark: SparkSession, root: str, data_type: str, run: str) -> None:
    """Delete the folder of one run of a table, through the store's own file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_path(root, data_type, run))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def moved(changes: DataFrame) -> DataFrame:
    """(data_type, run, by): where the rows of replaced runs are now. ``compact`` names runs that were replaced before again,
    so a chain of compactions is one step."""
    gone = changes.where("state = 'replaced'").groupBy("data_type", "run")
    return gone.agg(F.max_by("by", "made_at").alias("by"))


def compact(
    spark: SparkSession, data_type: str, root: str, into: str, rows: DataFrame | None = None, at: datetime | None = None
) -> DataFrame:
    """Write the runs in force as the one run ``into``, and swap them. Returns the replaced runs (run).

    ``rows`` are the rows to keep, by default all versions in force; ``at`` (default: after the last commit) is the moment from which
    readers take the new run. Which runs are folded is fixed before any row is read: a run that is committed meanwhile stays as
    it is. Until the commit, readers see the old runs; after it the new one; the old folders are left to ``expire``.
    """
    changes = run_changes(spark, root)
    if changes is None:
        raise ValueError("nothing was committed to this table")
    plan = f"{run_changes_path(root)}_plans/{data_type}/{into}"
    in_force(changes, data_type).coalesce(1).write.mode("overwrite").parquet(plan)
    folded = spark.read.schema("run string").parquet(plan)
    if rows is None:
        from marketlake.sources.lake import live_rows, read_canonical, read_catalog

        stored = read_canonical(spark, root, data_type)
        rows = live_rows(stored, read_catalog(spark, root, "registry"), read_catalog(spark, root, "tombstones"))
    write_compacted(rows.join(folded, "run", "left_semi"), data_type, root, into)
    # Runs that went into a folded one are now where that goes.
    before = changes.where((F.col("data_type") == data_type) & (F.col("state") == "replaced")).select("run").distinct()
    last = changes.agg(F.max("made_at") + F.expr("INTERVAL 1 MICROSECOND")).first()[0]
    commit_runs(spark, data_type, root, into, at or last, into, folded.unionByName(before).distinct())
    return folded


def expire(spark: SparkSession, data_type: str, root: str, before: datetime) -> list[str]:
    """Delete the folders of runs that were replaced at or before a moment; the table can then only be read as of later ones."""
    changes = run_changes(spark, root, before)
    if changes is None:
        return []
    gone = changes.where((F.col("data_type") == data_type) & (F.col("state") == "replaced")).select("run").distinct()
    names = [r.run for r in gone.collect()]  # one name per removed folder
    for run in names:
        remove_run(spark, root, data_type, run)
    return sorted(names)
