"""Unpivots, rosters, slates and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.scalars import period


def team_sides(games: DataFrame, keep: Sequence[str], paired: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per team of a contest from one scan.

    ``paired`` maps an output name to its (home column, away column); the away
    side swaps nothing by itself, so points against is ("away_score", "home_score").
    """
    def side(index: int, flag: bool) -> Column:
        return F.struct(
            *[F.col(pair[index]).alias(name) for name, pair in paired.items()],
            F.lit(flag).alias("is_home"),
        )

    return games.select(*keep, F.explode(F.array(side(0, True), side(1, False))).alias("__s")).select(
        *keep, "__s.*"
    )


def team_points_long(games: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return team_sides(
        games, ["game_id", "season", "week", "kickoff", *extra],
        {
            "team": ("home_team", "away_team"),
            "opponent": ("away_team", "home_team"),
            "points_for": ("home_score", "away_score"),
            "points_against": ("away_score", "home_score"),
        },
    )


def listed_starters(games: DataFrame) -> DataFrame:
    return (
        team_sides(
            games, ["game_id", "season", "week", "kickoff"],
            {"team": ("home_team", "away_team"), "player_id": ("home_qb_id", "away_qb_id")},
        )
        .where(F.col("player_id").isNotNull())
        .withColumn("period", period(F.col("season"), F.col("week")))
    )


def projected_points(scored: DataFrame) -> DataFrame:
    """Projected points per team-game, distinct on (game, team)."""
    return team_sides(
        scored, ["game_id"],
        {"team": ("home_team", "away_team"), "proj_points": ("home_team_total", "away_team_total")},
    ).groupBy("game_id", "team").agg(F.max("proj_points").alias("proj_points"))


def team_universe(games: DataFrame) -> DataFrame:
    """Distinct teams; the union folds map-side before its shuffle."""
    return games.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def roster_before(
    player_weeks: DataFrame, season: int, week: int, teams: DataFrame,
    identity: Sequence[str] = ("player_id", "team"),
    window: int = K.ROSTER_WINDOW, minimum: int = K.ROSTER_MIN_APPEARANCES,
) -> DataFrame:
    """Players seen for the given teams in the last ``window`` weeks.

    Plain YYYYWW arithmetic, so the window never reaches into a prior season.
    """
    now = season * 100 + week
    clock = period(F.col("season"), F.col("week"))
    recent = player_weeks.where(
        (F.col("season") == season) & (clock < now) & (clock >= now - window)
    ).join(teams.select("team"), "team", "left_semi")
    return (
        recent.groupBy(*identity).agg(F.count("*").alias("appearances"))
        .where(F.col("appearances") >= minimum)
    )


def slate_player_rows(roster: DataFrame, slate: DataFrame) -> DataFrame:
    """Pair each projected player with the team's contests on a slate."""
    sides = team_sides(
        slate, ["game_id", "season", "week"],
        {"team": ("home_team", "away_team"), "opponent_team": ("away_team", "home_team")},
    ).drop("is_home")
    return roster.join(sides, "team")


def append_slate_rows(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History plus empty-statistic slate rows, in one frame for one window pass."""
    wanted = [c for c in rows.columns if c in history.columns]
    return history.withColumn("is_slate", F.lit(False)).unionByName(
        rows.select(*wanted).withColumn("is_slate", F.lit(True)), allowMissingColumns=True
    )


def slate_status(games: DataFrame) -> DataFrame:
    return games.groupBy("season", "week").agg(
        F.count("*").alias("games"),
        F.avg(F.col("completed").cast("double")).alias("played"),
    )


def target_slate(games: DataFrame, season: int | None = None, week: int | None = None) -> DataFrame:
    """One row (season, week): the slate to predict.

    The first slate with an unplayed game, moved on to the next such slate
    once half of it is played; with nothing pending, the last played slate.
    Works on the slate-level aggregate; raises for an unknown season.
    """
    slates = slate_status(games)
    if week:
        if season:
            return games.sparkSession.range(1).select(
                F.lit(int(season)).alias("season"), F.lit(int(week)).alias("week"))
        return games.agg(F.max("season").alias("season")).select("season", F.lit(int(week)).alias("week"))
    if season:
        slates = slates.where(F.col("season") == season)
        if slates.isEmpty():
            raise ValueError(f"no games on record for {season}")
    clock = period(F.col("season"), F.col("week"))
    pending = F.when(F.col("played") < 1, clock)
    following = F.min(pending).over(W.orderBy("season", "week").rowsBetween(1, W.unboundedFollowing))
    facts = slates.select(
        "season", "week", "played", clock.alias("clock"), pending.alias("pending"), following.alias("following")
    ).agg(
        F.min("pending").alias("first"),
        F.min_by(F.struct("played", "following"), "pending").alias("at_first"),
        F.max(F.when(F.col("played") > 0, F.col("clock"))).alias("last"),
    )
    rolls = (F.col("at_first.played") >= 0.5) & F.col("at_first.following").isNotNull()
    pick = F.coalesce(F.when(rolls, F.col("at_first.following")).otherwise(F.col("first")), F.col("last"))
    return facts.select(
        F.floor(pick / 100).cast("int").alias("season"), (pick % 100).cast("int").alias("week")
    )


def slate_grid(games: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Distinct completed periods in the season range."""
    wanted = F.col("completed") & (F.col("season") >= start)
    if end is not None:
        wanted = wanted & (F.col("season") <= end)
    return games.where(wanted).select(period(F.col("season"), F.col("week")).alias("period")).distinct()


def training_history(games: DataFrame, season: int, week: int) -> DataFrame:
    """Completed games before the slate's first kickoff.

    Without a kickoff on record, completed games of earlier periods.  The
    cutoff is one value, read first so that it reaches the scan as a filter.
    """
    on_slate = (F.col("season") == season) & (F.col("week") == week)
    cut = games.where(on_slate).agg(F.min("kickoff")).first()[0]
    clock = period(F.col("season"), F.col("week"))
    earlier = clock < season * 100 + week if cut is None else F.col("kickoff") < F.lit(cut)
    return games.where("completed").where(earlier)


def top_per_category(
    rows: DataFrame, categories: Sequence[str], top: int, identity: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """Top rows per value column, positives only; ranking is limited map-side."""
    long = rows.unpivot(list(identity), list(categories), "category", "value").where(F.col("value") > 0)
    order = W.partitionBy("category").orderBy(F.desc(F.round("value", 9)), *tie)
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def trailing_team_table(games: DataFrame, window: int = K.TEAM_TABLE_GAMES) -> DataFrame:
    """Average points for and against over each team's last games."""
    long = team_points_long(games.where("completed"))
    recent = W.partitionBy("team").orderBy(
        F.desc("season"), F.desc("week"), F.desc("kickoff"), F.desc("game_id")
    )
    return (
        long.withColumn("__r", F.row_number().over(recent)).where(F.col("__r") <= window)
        .groupBy("team").agg(
            F.count("*").alias("games"),
            F.avg("points_for").alias("points_for"),
            F.avg("points_against").alias("points_against"),
        )
    )


def attach_by_key(frame: DataFrame, predictions: DataFrame, key: str = "game_id") -> DataFrame:
    """Left join on the key; a prediction column replaces one of the same name."""
    clashes = [c for c in predictions.columns if c != key and c in frame.columns]
    return frame.drop(*clashes).join(predictions, key, "left")
