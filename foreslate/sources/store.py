"""Derived tables kept per season, sinks, and the store of scored runs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K

_LOCAL_FOLDERS: dict[str, str] = {}
#: Paths written in the open blocks of :func:`temporaries`, the innermost last.
_WITHIN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent, a single process (``local[...]``, as in tests) gets a
    fresh folder of its own; on a cluster its absence is an error, as
    executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[context.applicationId]


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application has kept in the shared folder; call it when its results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Used where several plans read one result.  Unlike a cache it keeps plans
    small, gives the optimizer real sizes, lets later scans prune columns and
    does not depend on any executor staying alive.
    """
    return _written(df, name, _WITHIN)


def _written(df: DataFrame, name: str, within: Sequence[list[str]]) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    for own in within[-1:]:
        own.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    # executors drop a shuffle's files once the driver has collected its plan
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, which nothing reads any more."""
    _delete(df.sparkSession, {os.path.dirname(file) for file in df.inputFiles()})


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within are deleted at the end."""
    _WITHIN.append(own := [])
    try:
        yield
    finally:
        _WITHIN.pop()
        _delete(spark, own)


def materialize_alone(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` of what ``build`` gives; tables it materialized on the way are deleted then.

    Nothing else may read those, so inputs that others share are made before the call.
    """
    outer = list(_WITHIN)
    with temporaries(spark):
        return _written(build(), name, outer)


# --- per-season derived tables --------------------------------------------


def write_by_season(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per season; rows of a season spread over many files.

    The repartition is by (season, salt), so one large season does not become
    a single write task.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    (
        df.repartition(F.col("season"), salt)
        .write.mode(mode).partitionBy("season").parquet(path)
    )


def stored_seasons(spark: SparkSession, path: str) -> list[int]:
    """Seasons present in a store, from its partition directories alone."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("season="))


def build_missing_seasons(
    spark: SparkSession,
    path: str,
    wanted: Iterable[int],
    build: Callable[[list[int]], DataFrame],
    refresh: bool = False,
) -> list[int]:
    """Build only the wanted seasons the store lacks, all in one Spark job."""
    have = set() if refresh else set(stored_seasons(spark, path))
    missing = sorted(set(int(s) for s in wanted) - have)
    if missing:
        refresh_partition(build(missing), path)
    return missing


def refresh_partition(df: DataFrame, path: str) -> None:
    """Replace just the seasons present in ``df``; the other seasons stay."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    (
        df.repartition(F.col("season"), salt)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("season").parquet(path)
    )


def read_seasons(spark: SparkSession, path: str, seasons: Iterable[int] | None = None) -> DataFrame:
    stored = spark.read.option("mergeSchema", True).parquet(path)
    return stored if seasons is None else stored.where(F.col("season").isin(sorted(set(seasons))))


# --- sinks -----------------------------------------------------------------


def write_columns(df: DataFrame, columns: Iterable[str], path: str, fmt: str = "csv") -> DataFrame:
    """Write the named columns that exist, in that order; returns what was written."""
    existing = [c for c in columns if c in df.columns]
    out = df.select(*existing)
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    return out


def write_slate(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    return write_columns(df, K.SLATE_COLUMNS, path, fmt)


def write_scorecard(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    return write_columns(df, K.SCORECARD_COLUMNS, path, fmt)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    return write_columns(df, df.columns, path, fmt)


# --- scored runs -----------------------------------------------------------

RUN_VERSION = 2


def _score_digest() -> Column:
    """A number for a contest's id and margin, the same on any engine."""
    told = F.concat_ws(":", F.col("game_id").cast("string"), F.round(F.col("margin") * 1000).cast("long"))
    return F.conv(F.substring(F.md5(told), 1, 8), 16, 10).cast("long")


def run_fingerprint(games: DataFrame, **options) -> DataFrame:
    """One row naming a run by its inputs: data extent, completed scores and settings.

    ``settings`` is a text of all other options that change the rows.

    The last completed game is found by ``max_by`` over the order tuple, so
    the aggregate is partial on the map side and no sort is needed.
    """
    order = F.struct("season", "week", "kickoff", "game_id")
    done = F.col("completed")
    facts = games.agg(
        F.count_if(done).alias("completed_games"),
        F.coalesce(
            F.max_by(F.col("game_id").cast("string"), F.when(done, order)), F.lit("")
        ).alias("last_game_id"),
        # a corrected score changes neither the count nor the last id
        F.coalesce(F.sum(F.when(done, _score_digest())), F.lit(0)).alias("scores"),
        F.max("season").cast("int").alias("last_season"),
    )
    named = facts.select(
        F.lit(RUN_VERSION).alias("version"),
        "completed_games",
        "last_game_id",
        F.lit(int(options.get("start_season", K.BACKTEST_START))).alias("start_season"),
        F.coalesce(F.lit(options.get("end_season")).cast("int"), F.col("last_season")).alias("end_season"),
        F.lit(bool(options.get("use_market", True))).alias("use_market"),
        F.lit(round(float(options.get("market_blend", K.MARKET_BLEND)), 4)).alias("market_blend"),
        F.lit(round(float(options.get("total_blend", K.TOTAL_BLEND)), 4)).alias("total_blend"),
        F.lit(bool(options.get("use_passers", True))).alias("use_passers"),
        F.lit(str(options.get("refit", "season"))).alias("refit"),
        "scores",
        F.lit(str(options.get("settings", ""))).alias("settings"),
    )
    digest = F.sha2(F.to_json(F.struct(*named.columns)), 256)
    return named.withColumn("run_id", F.substring(digest, 1, 16))


def cached_run(
    games: DataFrame, path: str, score: Callable[[], DataFrame], **options
) -> tuple[DataFrame, bool]:
    """Scored rows of a run, reused when the same fingerprint is stored.

    Only per-game rows are stored; every summary is recomputed from them.
    """
    spark = games.sparkSession
    run_id = run_fingerprint(games, **options).first()["run_id"]
    folder = os.path.join(path, f"run_id={run_id}")
    marker = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, "_SUCCESS"))
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    hit = bool(fs.exists(marker))
    if not hit:
        score().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder), hit
