"""Source tables: read, coerce, normalise and derive.

Each loader takes a landed CSV (or Parquet) path and keeps only the columns
its contract names, so Parquet scans stay pruned.  Season selections are
plain filters and therefore prune partitions of season-partitioned stores.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions.scalars import injury_availability, normalize_team
from . import schemas as S

GAME_ORDER = ("season", "week", "kickoff", "game_id")


def read_table(spark: SparkSession, path: str, contract: dict[str, str]) -> DataFrame:
    """Read a landed table; CSV columns arrive as text and are coerced by name."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    return S.align_to_schema(raw, contract)


def keep_seasons(df: DataFrame, seasons: Iterable[int] | None, first: int) -> DataFrame:
    """Rows of the wanted seasons, never earlier than the first available one."""
    if seasons is None:
        return df.where(F.col("season") >= first)
    return df.where(F.col("season").isin(sorted({int(s) for s in seasons if int(s) >= first})))


def kickoff_time(gameday: Column, gametime: Column) -> Column:
    """Date plus time of day; an unreadable time means midnight."""
    clock = F.regexp_extract(gametime, r"^\s*(\d{1,2}):(\d{2})\s*$", 1).try_cast("int")
    minute = F.regexp_extract(gametime, r"^\s*(\d{1,2}):(\d{2})\s*$", 2).try_cast("int")
    zero = F.lit(0)
    offset = F.make_dt_interval(zero, F.coalesce(clock, zero), F.coalesce(minute, zero))
    return gameday.try_cast("date").cast("timestamp_ntz") + offset


def outcome_value(margin: Column) -> Column:
    return F.when(margin > 0, 1.0).when(margin < 0, 0.0).when(margin == 0, K.TIE_CREDIT)


def derive_game_columns(games: DataFrame, mapping=None) -> DataFrame:
    """Add kickoff, completed, margin, home_win, neutral, is_playoff to a raw log."""
    return (
        games.withColumns({
            "home_team": normalize_team(F.col("home_team"), mapping),
            "away_team": normalize_team(F.col("away_team"), mapping),
            "kickoff": kickoff_time(F.col("gameday"), F.col("gametime")),
            "completed": F.col("result").isNotNull(),
            "margin": F.col("result"),
            "home_win": outcome_value(F.col("result")),
            "neutral": F.coalesce(F.col("location") == "Neutral", F.lit(False)),
            "is_playoff": F.coalesce(F.col("game_type") != "REG", F.lit(True)),
            "league": F.coalesce("league", F.lit(S.ONE_LEAGUE)) if "league" in games.columns else F.lit(S.ONE_LEAGUE),
        })
    )


def load_games(spark: SparkSession, path: str, mapping=None) -> DataFrame:
    return derive_game_columns(read_table(spark, path, S.GAME_LOG), mapping)


def load_plays(spark: SparkSession, path: str, seasons=None, first=K.FIRST_PLAY_SEASON, mapping=None) -> DataFrame:
    """Plays with normalised teams; ``seq`` is the order of play within a game."""
    plays = keep_seasons(read_table(spark, path, S.PLAYS), seasons, first)
    return plays.withColumns({c: normalize_team(F.col(c), mapping) for c in ("posteam", "defteam")})


def load_half_plays(spark: SparkSession, path: str, seasons=None, first=K.FIRST_PLAY_SEASON) -> DataFrame:
    return keep_seasons(read_table(spark, path, S.HALVES), seasons, first)


def derive_player_columns(rows: DataFrame) -> DataFrame:
    """Dropbacks (attempts plus sacks) and passing value per dropback."""
    dropbacks = F.coalesce(F.col("attempts"), F.lit(0.0)) + F.coalesce(
        F.col("sacks_suffered"), F.lit(0.0)
    )
    rate = F.when(dropbacks > 0, F.col("passing_epa") / dropbacks)
    return rows.withColumns({"dropbacks": dropbacks, "passing_epa_per_dropback": rate})


def load_player_weeks(
    spark: SparkSession, path: str, seasons=None, first=K.FIRST_PLAYER_SEASON, mapping=None
) -> DataFrame:
    rows = keep_seasons(read_table(spark, path, S.PLAYER_WEEKS), seasons, first)
    rows = rows.withColumns(
        {c: normalize_team(F.col(c), mapping) for c in ("team", "opponent_team")}
    )
    return derive_player_columns(rows)


def derive_report_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "report_status": F.trim("report_status"),
        "availability": injury_availability(F.col("report_status")),
    })


def load_injuries(
    spark: SparkSession, path: str, seasons=None, first=K.FIRST_REPORT_SEASON, mapping=None
) -> DataFrame:
    rows = keep_seasons(read_table(spark, path, S.INJURIES), seasons, first)
    return derive_report_columns(rows.withColumn("team", normalize_team(F.col("team"), mapping)))
