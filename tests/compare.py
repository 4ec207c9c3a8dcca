"""Compare the registered queries with their SQL oracles: ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, in value order; NaN and null are one."""
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None where both agree, else what differs."""
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and len(ours) and len(theirs)}
    if odd:
        return f"types {odd}"
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; e.g. {sorted(set(a) ^ set(b), key=repr)[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from marketlake.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    oracles, failures = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, oracles[name], sf_dir) if name in oracles else f"no oracle, {query(spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on with the others
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failures += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
