"""Reductions from plays and player rows to team-games, halves and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.scalars import as_number, clip

FLAGS = ("pass", "rush", "success", "interception", "fumble_lost", "sack")
SUMMARY_STATS = (
    "plays", "drives", "plays_per_drive", "epa_play", "pass_epa", "rush_epa", "success",
    "explosive", "turnover_rate", "sack_rate", "pass_rate",
)


def scrimmage_plays(plays: DataFrame, kinds=("pass", "run")) -> DataFrame:
    return plays.where(
        F.col("play_type").isin(*kinds) & F.col("epa").isNotNull()
        & F.col("posteam").isNotNull() & F.col("defteam").isNotNull()
    )


def coerce_flags(plays: DataFrame) -> DataFrame:
    """Indicator columns as numbers; missing values and absent columns are 0."""
    present = set(plays.columns)
    return plays.withColumns({
        c: F.coalesce(as_number(F.col(c)), F.lit(0.0)) if c in present else F.lit(0.0)
        for c in FLAGS
    })


def play_outcomes(plays: DataFrame) -> DataFrame:
    lost = clip(F.col("interception"), 0, 1) + clip(F.col("fumble_lost"), 0, 1)
    return plays.withColumns({
        "explosive": F.when(F.col("yards_gained") >= K.EXPLOSIVE_YARDS, 1.0).otherwise(0.0),
        "turnover": clip(lost, 0, 1),
    })


def offence_summary(plays: DataFrame) -> DataFrame:
    """Eleven offence measures per (game, season, week, team), one shuffle.

    ``plays`` must already carry outcomes and coerced flags.
    """
    passing, rushing = F.col("pass") > 0, F.col("rush") > 0

    def mean_where(flag: Column, value: str) -> Column:
        return F.avg(F.when(flag, F.col(value)))

    # a game has tens of drives: a set keeps the aggregation to one shuffle, distinct counts take two
    drives = F.size(F.collect_set("drive")).cast("double")
    return plays.groupBy("game_id", "season", "week", F.col("posteam").alias("team")).agg(
        F.count("*").cast("double").alias("off_plays"),
        drives.alias("off_drives"),
        F.avg("epa").alias("off_epa_play"),
        mean_where(passing, "epa").alias("off_pass_epa"),
        mean_where(rushing, "epa").alias("off_rush_epa"),
        F.avg("success").alias("off_success"),
        F.avg("explosive").alias("off_explosive"),
        F.avg("turnover").alias("off_turnover_rate"),
        F.coalesce(mean_where(passing, "sack"), F.lit(0.0)).alias("off_sack_rate"),
        F.avg(F.when(passing, 1.0).otherwise(0.0)).alias("off_pass_rate"),
        # the opponent of the earliest play, whatever order rows arrive in
        F.min_by("defteam", "seq").alias("opponent"),
    ).withColumn(
        "off_plays_per_drive",
        F.when(F.col("off_drives") > 0, F.col("off_plays") / F.col("off_drives")),
    )


def mirror_defence(offence: DataFrame) -> DataFrame:
    """A team's defence is its opponent's offence in the same game.

    A game has its two summary rows, so they are put side by side in one
    shuffle on the game instead of joining the summary to itself.
    """
    row = F.struct("team", *[F.col(f"off_{s}").alias(f"def_{s}") for s in SUMMARY_STATS])
    sides = F.collect_list(row).over(W.partitionBy("game_id"))
    other = F.get(F.filter("__sides", lambda r: r["team"] == F.col("opponent")), F.lit(0))
    return (
        offence.withColumn("__sides", sides).withColumn("__other", other)
        .select(*offence.columns, *[F.col(f"__other.def_{s}").alias(f"def_{s}") for s in SUMMARY_STATS])
    )


def team_games(plays: DataFrame, min_plays: int = K.FORM_MIN_PLAYS) -> DataFrame:
    """Plays to team-game rows with mirrored defence columns.

    Expects ``seq`` (order of play); teams are already normalised.
    """
    offence = offence_summary(play_outcomes(coerce_flags(scrimmage_plays(plays))))
    return mirror_defence(offence.where(F.col("off_plays") >= min_plays))


def half_scores(plays: DataFrame) -> DataFrame:
    """Score at the break: largest running score of the first two quarters."""
    return plays.where(F.col("qtr") <= 2).groupBy("game_id", "season").agg(
        F.max("total_home_score").alias("home_first_half"),
        F.max("total_away_score").alias("away_first_half"),
    )


def running_scores(plays: DataFrame) -> DataFrame:
    """Cumulative score per play, where a source lacks it (points = yards)."""
    upto = W.partitionBy("game_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return plays.withColumns({
        "total_home_score": F.sum(F.when(F.col("posteam") == F.col("home_team"), F.col("yards_gained")).otherwise(0.0)).over(upto),
        "total_away_score": F.sum(F.when(F.col("posteam") == F.col("away_team"), F.col("yards_gained")).otherwise(0.0)).over(upto),
    })


def defence_allowed(player_weeks: DataFrame) -> DataFrame:
    """Yards given up per defence and week; an all-missing group counts as 0."""
    return player_weeks.groupBy(F.col("opponent_team").alias("team"), "season", "week").agg(
        F.coalesce(F.sum("passing_yards"), F.lit(0.0)).alias("pass_yards_allowed"),
        F.coalesce(F.sum("rushing_yards"), F.lit(0.0)).alias("rush_yards_allowed"),
    )


def fit_facts(train: DataFrame, prediction: Column, target: Column) -> DataFrame:
    """What a fit saw: rows, seasons, residual spread and error."""
    miss = target - prediction
    return train.agg(
        F.count("*").alias("n_train"),
        F.array_join(F.sort_array(F.collect_set("season")).cast("array<string>"), ",").alias("seasons"),
        F.stddev_pop(miss).alias("sigma"),
        F.avg(F.abs(miss)).alias("train_mae"),
    )
