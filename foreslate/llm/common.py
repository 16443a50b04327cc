"""What the operators of this folder share."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shipping import ship_package

#: Rows and bytes of one Arrow batch handed to Python; keeps a batch of long texts small.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def python_ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers and bound their Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_HELD: dict = {}


def in_worker(key, build: Callable):
    """``build()``, kept in a worker process from task to task until something else is held."""
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Let go of what the worker has kept; work that keeps nothing starts with this, as workers are shared."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_remainder(name: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % divisor


def buckets(spark: SparkSession) -> int:
    """How many parts a shuffle of packed rows is dealt into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
