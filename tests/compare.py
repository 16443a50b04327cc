"""Run queries on Spark and DuckDB and compare by value.

    python tests/compare.py /root/testdata/sf0.01 [key prefix ...]

ONLY_SQL=1 leaves out the queries that are checked for rows alone.
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

#: The folder that tests read.
SMALL = "/root/testdata/sf0.001"


def session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("foreslate")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(query, spark, con, folder) -> str | None:
    """None when equal, else what differs."""
    df = query.run(spark, folder)
    left, names = df.collect(), df.columns
    if query.sql is None:
        return None if left else "no rows"
    result = con.execute(query.oracle())
    other = [d[0] for d in result.description]
    right = result.fetchall()
    if sorted(names) != sorted(other):
        return f"columns {sorted(set(names) ^ set(other))}"
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    if doubles != set(query.floats):
        return f"float columns {sorted(doubles ^ set(query.floats))}"
    a, b = normal(left, names), normal(right, other)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    if not a:
        return "no rows on either side"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ ({sorted(names)}): {bad[0]}"
    return None


def main() -> None:
    from foreslate.catalog import REGISTRY

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    failed = 0
    for key, query in REGISTRY.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        if os.environ.get("ONLY_SQL") and query.sql is None:
            continue
        start = time.time()
        try:
            problem = compare(query, spark, con, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            lines = [x for x in str(error).splitlines() if x.strip() and not x.strip().startswith("at ")]
            problem = f"{type(error).__name__}: " + " | ".join([lines[0][:300], *lines[1:][-4:]])[:900]
        kind = "sql " if query.sql else "rows"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {key}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
