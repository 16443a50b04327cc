"""Player form, context and slate rows for yardage projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.scalars import clean_feature, injury_availability, period, safe_ratio
from ..operators.aggregates import defence_allowed
from ..operators.reshape import append_slate_rows, roster_before, slate_player_rows, team_universe
from ..operators.scans import bias_corrected_mean, decayed_scan, decayed_sum

ROLLED = {
    "passing_yards": "form_pass_yards", "attempts": "form_attempts",
    "rushing_yards": "form_rush_yards", "carries": "form_carries",
    "receiving_yards": "form_rec_yards", "targets": "form_targets",
    "target_share": "form_target_share",
}


def player_form(rows: DataFrame) -> DataFrame:
    """Weighted mean of each player's earlier games, plus the appearance count.

    Slate rows sort after every played row, so they read the whole history
    and feed nobody.
    """
    have = set(rows.columns)
    zero = F.lit(0.0)
    filled = rows.withColumns({
        c: F.coalesce(F.col(c).try_cast("double"), zero) if c in have else zero for c in ROLLED
    })
    if "is_slate" not in have:
        filled = filled.withColumn("is_slate", F.lit(False))
    rolled = decayed_scan(
        filled, entity=["player_id"], order=["season", "week", "is_slate", "game_id", "team", "opponent_team"],
        values={c: decayed_sum(K.PLAYER_ALPHA) for c in ROLLED},
    )
    out = rolled.withColumns({
        **{f: bias_corrected_mean(c, K.PLAYER_ALPHA) for c, f in ROLLED.items()},
        "form_games": F.col("attempts__n").cast("double"),
    })
    return out.select(
        "player_id", "season", "week", "is_slate", "game_id", "team", "opponent_team",
        *ROLLED, *ROLLED.values(), "form_games",
    )


def efficiency(frame: DataFrame) -> DataFrame:
    """Rates from the rolled pair, never rolled themselves."""
    pairs = {
        "form_pass_ypa": ("form_pass_yards", "form_attempts"),
        "form_rush_ypc": ("form_rush_yards", "form_carries"),
        "form_rec_ypt": ("form_rec_yards", "form_targets"),
    }
    return frame.withColumns({
        name: safe_ratio(F.col(top), F.col(bottom), K.RATE_BOUNDS[name])
        for name, (top, bottom) in pairs.items()
    })


def defence_form(player_weeks: DataFrame) -> DataFrame:
    """Weighted mean of yards each defence allowed in earlier weeks."""
    columns = ("pass_yards_allowed", "rush_yards_allowed")
    rolled = decayed_scan(
        defence_allowed(player_weeks), entity=["team"], order=["season", "week"],
        values={c: decayed_sum(K.PLAYER_ALPHA) for c in columns},
    )
    return rolled.select(
        "team", "season", "week",
        *[bias_corrected_mean(c, K.PLAYER_ALPHA).alias(f"opp_{c}") for c in columns],
    )


def attach_schedule(frame: DataFrame, games: DataFrame) -> DataFrame:
    sched = games.select("game_id", "home_team", "away_team")
    home = F.coalesce(F.col("team") == F.col("home_team"), F.lit(False)).cast("double")
    return frame.join(sched, "game_id", "left").withColumn("is_home", home)


def attach_availability(frame: DataFrame, injuries: DataFrame | None) -> DataFrame:
    """One listing per (season, week, player), the first by team; unlisted is 1."""
    if injuries is None:
        return frame.withColumn("availability", F.lit(1.0))
    order = F.struct("team", F.coalesce("report_status", F.lit("")))
    report = injuries.where(F.col("gsis_id").isNotNull()).groupBy(
        "season", "week", F.col("gsis_id").alias("player_id")
    ).agg(F.min_by(F.struct("report_status"), order).alias("r"))
    listed = report.select("season", "week", "player_id", "r.report_status")
    return frame.join(listed, ["season", "week", "player_id"], "left").withColumn(
        "availability", injury_availability(F.col("report_status"))
    ).drop("report_status")


def attach_points(frame: DataFrame, points: DataFrame | None) -> DataFrame:
    """Projected points for and against; the league average where absent."""
    average = F.lit(K.LEAGUE_AVERAGE_POINTS)
    if points is None:
        return frame.withColumns({"team_proj_points": average, "opp_proj_points": average})
    for column, name in (("team", "team_proj_points"), ("opponent_team", "opp_proj_points")):
        side = points.select("game_id", F.col("team").alias(column), F.col("proj_points").alias(name))
        frame = frame.join(side, ["game_id", column], "left").withColumn(name, F.coalesce(name, average))
    return frame


def build_player_features(
    rows: DataFrame, games: DataFrame, injuries: DataFrame | None = None, points: DataFrame | None = None
) -> DataFrame:
    """One row per player-game: form, context, availability and the outcome."""
    frame = efficiency(player_form(rows))
    allowed = defence_form(rows).withColumnRenamed("team", "opponent_team")
    frame = frame.join(allowed, ["opponent_team", "season", "week"], "left")
    frame = attach_points(attach_availability(attach_schedule(frame, games), injuries), points)
    return frame.withColumns({c: clean_feature(F.col(c)) for c in K.PLAYER_FEATURES})


def history_window(player_weeks: DataFrame, season: int, week: int, seasons: int = K.PLAYER_TRAIN_SEASONS) -> DataFrame:
    """Rows played before a slate, at most ``seasons`` seasons back."""
    before = period(F.col("season"), F.col("week")) < season * 100 + week
    return player_weeks.where(before & (F.col("season") >= season - seasons))


def player_frames(
    player_weeks: DataFrame, games: DataFrame, season: int, week: int,
    injuries: DataFrame | None = None, points: DataFrame | None = None,
    train_seasons: int = K.PLAYER_TRAIN_SEASONS,
) -> tuple[DataFrame, DataFrame]:
    """Training rows and slate rows from a single rolling pass."""
    slate = games.where((F.col("season") == season) & (F.col("week") == week))
    played = history_window(player_weeks, season, week, train_seasons)
    roster = roster_before(played, season, week, team_universe(slate))
    combined = append_slate_rows(played, slate_player_rows(roster, slate))
    built = build_player_features(combined, games, injuries, points)
    return built.where(~F.col("is_slate")), built.where("is_slate")
