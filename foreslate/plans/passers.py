"""Passer ratings, change-of-starter terms and roster availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.scalars import clip, period
from ..operators.reshape import listed_starters
from ..operators.scans import (
    asof_backward, center, decayed_scan, ewma, latest_per_clock, running_sum, state_after,
)
from ..sources.store import materialize


def passer_ratings(player_weeks: DataFrame, min_dropbacks: float = K.PASSER_MIN_DROPBACKS) -> DataFrame:
    """Rating before and after every passer-game with enough dropbacks.

    Mean of two exponentially weighted, centred and scaled measures, shrunk
    by dropbacks seen.
    """
    passers = player_weeks.where(F.coalesce("dropbacks", F.lit(0.0)) >= min_dropbacks).select(
        "player_id", "game_id", "season", "week", "team", "dropbacks",
        F.col("passing_cpoe").alias("cpoe"), F.col("passing_epa_per_dropback").alias("epa"),
    )
    centered = center(
        passers, ["cpoe", "epa"], scale={"cpoe": K.PASSER_CPOE_SCALE, "epa": K.PASSER_EPA_SCALE}
    )
    rule = ewma(K.PASSER_ALPHA)
    rolled = decayed_scan(
        centered, entity=["player_id"], order=["season", "week", "game_id", "team"],
        values={"cpoe": rule, "epa": rule, "dropbacks": running_sum()},
    )

    def rating(cpoe, epa, seen):
        parts = F.when(cpoe.isNull(), epa).when(epa.isNull(), cpoe).otherwise((cpoe + epa) / 2.0)
        return parts * (seen / (seen + K.PASSER_SHRINK_DROPBACKS))

    return rolled.select(
        "player_id", "game_id", "season", "week", "team",
        period(F.col("season"), F.col("week")).alias("period"),
        rating(F.col("cpoe__s"), F.col("epa__s"), F.col("dropbacks__s")).alias("qb_rating_pre"),
        rating(
            state_after("cpoe", rule), state_after("epa", rule), state_after("dropbacks", running_sum())
        ).alias("qb_rating_post"),
        F.col("dropbacks__s").alias("qb_dropbacks_pre"),
    )


def starter_ratings(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Each listed starter with the rating after the last strictly earlier week."""
    timeline = latest_per_clock(
        ratings, ["player_id"], "period", ["game_id", "team"], ["qb_rating_post"]
    )
    return asof_backward(
        listed_starters(games), timeline, key=["player_id"], clock="period", values=["qb_rating_post"]
    ).withColumnRenamed("qb_rating_post", "qb_rating_pre")


def team_passer_baseline(starters: DataFrame) -> DataFrame:
    """Who has been playing quarterback here: pregame average per team."""
    rolled = decayed_scan(
        starters, entity=["team"], order=["season", "week", "kickoff", "game_id", "is_home"],
        values={"qb_rating_pre": ewma(K.PASSER_TEAM_ALPHA)},
    )
    return rolled.select(
        "game_id", "team", "is_home", "season", "week", "qb_rating_pre",
        F.col("qb_rating_pre__s").alias("team_qb_baseline"),
    )


def passer_features(games: DataFrame, player_weeks: DataFrame,
                    min_dropbacks: float = K.PASSER_MIN_DROPBACKS) -> DataFrame:
    """``qb_delta`` and ``qb_edge`` per contest, home minus away, missing as 0."""
    ratings = materialize(passer_ratings(player_weeks, min_dropbacks), "passer-ratings")
    listed = materialize(starter_ratings(games, ratings), "starters")
    starters = team_passer_baseline(listed)
    change = F.coalesce(F.col("qb_rating_pre") - F.col("team_qb_baseline"), F.lit(0.0))
    level = F.coalesce(F.col("qb_rating_pre"), F.lit(0.0))
    sign = F.when(F.col("is_home"), 1.0).otherwise(-1.0)
    # one row per side, so a signed sum is home minus away in a single shuffle
    sides = starters.groupBy("game_id").agg(
        F.sum(sign * change).alias("qb_delta"), F.sum(sign * level).alias("qb_edge")
    )
    return games.select("game_id").join(sides, "game_id", "left").fillna(0.0, ["qb_delta", "qb_edge"])


def player_usage(player_weeks: DataFrame) -> DataFrame:
    """Average touches through and including each game with any touch."""
    touches = F.coalesce("targets", F.lit(0.0)) + F.coalesce("carries", F.lit(0.0))
    usage = (
        player_weeks.select("player_id", "season", "week", "team", "game_id", touches.alias("touches"))
        .where(F.col("touches") > 0)
    )
    rolled = decayed_scan(
        usage, entity=["player_id"], order=["season", "week", "game_id", "team"],
        values={"touches": running_sum()},
    )
    return rolled.select(
        "player_id", "season", "week", "team", "game_id", "touches",
        period(F.col("season"), F.col("week")).alias("period"),
        ((F.col("touches__s") + F.col("touches")) / (F.col("touches__n") + 1)).alias("usage_post"),
    )


def absence_cost(usage: DataFrame, injuries: DataFrame) -> DataFrame:
    """Share of a team's usage the report expects to be missing, per team-week.

    Report rows are not de-duplicated here; every listing counts.
    """
    usage = materialize(usage, "usage")
    players = latest_per_clock(usage, ["player_id"], "period", ["game_id", "team"], ["usage_post"])
    teams = usage.groupBy("team", "period").agg(F.sum("usage_post").alias("team_usage"))
    report = injuries.where(F.col("gsis_id").isNotNull()).select(
        "season", "week", "team", F.col("gsis_id").alias("player_id"), "availability",
        period(F.col("season"), F.col("week")).alias("period"),
    )
    listed = asof_backward(report, players, key=["player_id"], clock="period", values=["usage_post"])
    missing = (1.0 - F.col("availability")) * F.coalesce("usage_post", F.lit(0.0))
    cost = listed.groupBy("season", "week", "team", "period").agg(F.sum(missing).alias("missing"))
    cost = asof_backward(cost, teams, key=["team"], clock="period", values=["team_usage"])
    share = F.when(F.col("team_usage") > 0, F.col("missing") / F.col("team_usage"))
    return cost.withColumn("cost", clip(F.coalesce(share, F.lit(0.0)), 0.0, 1.0))


def availability_features(games: DataFrame, player_weeks: DataFrame, injuries: DataFrame) -> DataFrame:
    """``availability_edge`` per contest: away cost minus home cost.

    Zero in seasons without any report.
    """
    cost = absence_cost(player_usage(player_weeks), injuries).select("season", "week", "team", "cost")
    cost = materialize(cost, "absence-cost")
    covered = materialize(injuries.select("season").distinct(), "covered").withColumn("covered", F.lit(True))
    out = games.select("game_id", "season", "week", "home_team", "away_team")
    for side in ("home", "away"):
        out = out.join(
            cost.withColumnsRenamed({"team": f"{side}_team", "cost": f"{side}_cost"}),
            ["season", "week", f"{side}_team"], "left",
        )
    zero = F.lit(0.0)
    edge = F.coalesce("away_cost", zero) - F.coalesce("home_cost", zero)
    return out.join(covered, "season", "left").select(
        "game_id", F.when(F.col("covered"), edge).otherwise(zero).alias("availability_edge")
    )
