"""S-rows: sources, sinks and stores.  Everything written is derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import grading as G
from ..sources import readers as RD
from ..sources import store as ST
from . import frames as R
from .registry import query
from .shared_sql import floored, hit

MAPPING = {"FURNITURE/NATION_10": "FURNITURE/NATION_11", "BUILDING/NATION_3": "BUILDING/NATION_4"}


def _mapped(c: str) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MAPPING.items())
    return f"CASE {c} {whens} ELSE {c} END"


def _landed(fx, df, name: str) -> str:
    """Land a frame as headed CSV and return its path."""
    path = ST.scratch_path(fx.spark, name) + ".csv"
    df.write.option("header", True).csv(path)
    return path


@query("s1_game_log", floats="home_score home_rest spread_line margin home_win", ints="game_id season week", views="games", sql=f"""
SELECT game_id, season, week, {_mapped('home_team')} AS home_team, {_mapped('away_team')} AS away_team, home_score,
       CASE WHEN game_id % 13 <> 0 THEN home_rest END AS home_rest, spread_line, margin, completed, home_win, neutral, is_playoff
FROM games""")
def _(fx):
    games = RD.load_games(fx.spark, _landed(fx, R.raw_log(fx), "games"), MAPPING)
    return games.select("game_id", "season", "week", "home_team", "away_team", "home_score", "home_rest", "spread_line",
                        "margin", "completed", "home_win", "neutral", "is_playoff")


@query("s2_plays", floats="epa yards", ints="season rows fumbles", views="plays", sql="""
SELECT season, play_type, count(*) AS rows, sum(epa) AS epa, sum(yards_gained) AS yards, 0 AS fumbles FROM plays GROUP BY season, play_type""")
def _(fx):
    raw = R.flagged_plays(fx).withColumn("unused", F.lit("x"))
    plays = RD.load_plays(fx.spark, _landed(fx, raw, "plays"), first=1990)
    return plays.groupBy("season", "play_type").agg(
        F.count("*").alias("rows"), F.sum("epa").alias("epa"), F.sum("yards_gained").alias("yards"),
        F.count("fumble_lost").alias("fumbles"))


@query("s3_half_plays", floats="home away", ints="season rows", views="scored_plays", sql="""
SELECT season, count(*) AS rows, sum(total_home_score) AS home, sum(total_away_score) AS away FROM scored_plays GROUP BY season""")
def _(fx):
    plays = RD.load_half_plays(fx.spark, _landed(fx, R.scored_plays(fx), "halves"), first=1990)
    return plays.groupBy("season").agg(F.count("*").alias("rows"), F.sum("total_home_score").alias("home"),
                                       F.sum("total_away_score").alias("away"))


@query("s4_player_weeks", floats="attempts dropbacks passing_epa_per_dropback completions", ints="player_id game_id season",
       views="player_weeks", sql=f"""
SELECT player_id, game_id, season, {_mapped('team')} AS team, {_mapped('opponent_team')} AS opponent_team, attempts,
       attempts + sacks_suffered AS dropbacks, passing_epa / nullif(attempts + sacks_suffered, 0) AS passing_epa_per_dropback,
       NULL AS completions FROM player_weeks""")
def _(fx):
    path = _landed(fx, fx.player_weeks, "players")
    rows = RD.load_player_weeks(fx.spark, path, None, 1990, MAPPING)
    return rows.select("player_id", "game_id", "season", "team", "opponent_team", "attempts", "dropbacks",
                       "passing_epa_per_dropback", "completions")


@query("s5_injury_reports", floats="availability", ints="season week gsis_id", views="report", sql=f"""
SELECT season, week, {_mapped('team')} AS team, gsis_id, trim(report_status) AS report_status, availability FROM report""")
def _(fx):
    rows = RD.load_injuries(fx.spark, _landed(fx, fx.injuries, "injuries"), first=1990, mapping=MAPPING)
    return rows.select("season", "week", "team", "gsis_id", "report_status", "availability")


@query("s6_season_pruning", ints="season rows", views="plays",
       sql="SELECT season, count(*) AS rows FROM plays WHERE season IN (1996, 1998) GROUP BY season")
def _(fx):
    return RD.keep_seasons(fx.plays, [1998, 1996, 1998, 1980], 1990).groupBy("season").agg(F.count("*").alias("rows"))


SEASON_FACTS = "SELECT season, count(*) AS rows, sum(off_plays) AS plays FROM team_games GROUP BY season"


def _facts(df):
    return df.groupBy("season").agg(F.count("*").alias("rows"), F.sum("off_plays").alias("plays"))


@query("s7_union_of_seasons", floats="plays", ints="season rows", views="team_games", sql=SEASON_FACTS)
def _(fx):
    path = ST.scratch_path(fx.spark, "union")
    early = R.team_games(fx).where("season < 1998")
    ST.write_by_season(early.drop("def_pass_rate"), path)
    ST.refresh_partition(R.team_games(fx).where("season >= 1998"), path)
    return _facts(ST.read_seasons(fx.spark, path))


@query("s8_build_missing_seasons", floats="plays", ints="season rows", views="team_games", sql=f"""
SELECT *, season NOT IN (1996, 1997) AS built_now FROM ({SEASON_FACTS})""")
def _(fx):
    path = ST.scratch_path(fx.spark, "missing")
    source = R.team_games(fx)
    ST.write_by_season(source.where("season IN (1996, 1997)"), path)
    wanted = [r[0] for r in source.select("season").distinct().collect()]
    built = ST.build_missing_seasons(
        fx.spark, path, wanted, lambda missing: source.where(F.col("season").isin(missing)))
    return _facts(ST.read_seasons(fx.spark, path)).withColumn("built_now", F.col("season").isin(built))


@query("s9_write_by_season", floats="plays", ints="season rows", views="team_games", sql=SEASON_FACTS)
def _(fx):
    path = ST.scratch_path(fx.spark, "by-season")
    ST.write_by_season(R.team_games(fx), path)
    return _facts(ST.read_seasons(fx.spark, path, ST.stored_seasons(fx.spark, path)))


@query("s10_refresh_current_season", floats="plays", ints="season rows", views="team_games", sql=f"""
SELECT season, rows, CASE WHEN season = max(season) OVER () THEN plays * 2 ELSE plays END AS plays FROM ({SEASON_FACTS})""")
def _(fx):
    path = ST.scratch_path(fx.spark, "refresh")
    ST.write_by_season(R.team_games(fx), path)
    current = ST.stored_seasons(fx.spark, path)[-1]
    corrected = R.team_games(fx).where(F.col("season") == current).withColumn("off_plays", F.col("off_plays") * 2)
    ST.refresh_partition(corrected, path)
    return _facts(ST.read_seasons(fx.spark, path))


@query("s11_slate_sink", floats="prob_home spread_edge kelly pred_total", ints="game_id season week columns", views="priced", sql="""
SELECT game_id, season, week, pick, confidence, prob_home, spread_edge, kelly, pred_total, ou_pick, 25 AS columns FROM priced""")
def _(fx):
    path = ST.scratch_path(fx.spark, "slate")
    ST.write_slate(R.priced(fx), path)
    back = fx.spark.read.option("header", True).csv(path)
    return back.select("game_id", "season", "week", "pick", "confidence", "prob_home", "spread_edge", "kelly",
                       "pred_total", "ou_pick", F.lit(len(back.columns)).alias("columns"))


@query("s12_scorecard_sink", floats="pick_prob hit ats_win ou_win total_error", ints="game_id season week columns",
       views="graded", sql="SELECT game_id, season, week, pick, pick_prob, hit, ats_win, ou_win, total_error, 19 AS columns FROM graded")
def _(fx):
    path = ST.scratch_path(fx.spark, "scorecard")
    ST.write_scorecard(R.graded(fx), path, "parquet")
    back = fx.spark.read.parquet(path)
    return back.select("game_id", "season", "week", "pick", "pick_prob", "hit", "ats_win", "ou_win", "total_error",
                       F.lit(len(back.columns)).alias("columns"))


@query("s13_prediction_sink", floats="prob_home pred_total", ints="game_id", views="scored",
       sql="SELECT game_id, prob_home, pred_total FROM scored WHERE completed")
def _(fx):
    path = ST.scratch_path(fx.spark, "predictions")
    ST.write_predictions(R.settled(fx).drop("kickoff"), path)
    return fx.spark.read.option("header", True).csv(path).select("game_id", "prob_home", "pred_total")


@query("s14_stored_run", floats="accuracy brier", ints="season games", views="scored", sql=f"""
SELECT season, count(*) AS games, avg({hit('prob_home')}) AS accuracy, avg(pow({floored('prob_home')} - home_win, 2)) AS brier,
       FALSE AS first_hit, TRUE AS second_hit FROM scored WHERE completed GROUP BY season""")
def _(fx):
    path = ST.scratch_path(fx.spark, "runs")
    score = lambda: R.settled(fx)
    _, first = ST.cached_run(fx.games, path, score, start_season=1996)
    rows, second = ST.cached_run(fx.games, path, score, start_season=1996)
    return G.by_season(rows).withColumns({"first_hit": F.lit(first), "second_hit": F.lit(second)})


@query("s15_run_fingerprint", ints="completed_games end_season", views="games", sql=f"""
SELECT completed_games, last_game_id, end_season, substring(sha256(
  '{{"version":{ST.RUN_VERSION},"completed_games":' || completed_games || ',"last_game_id":"' || last_game_id
  || '","start_season":{K.BACKTEST_START},"end_season":' || end_season || ',"use_market":true,"market_blend":0.1,"total_blend":0.1,'
  || '"use_passers":true,"refit":"season","scores":' || scores || ',"settings":""}}'), 1, 16) AS run_id
FROM (SELECT count(*) FILTER (WHERE completed) AS completed_games, max(season) AS end_season,
             (sum(('0x' || substring(md5(CAST(game_id AS VARCHAR) || ':' || CAST(round(margin * 1000) AS BIGINT)), 1, 8))::BIGINT)
              FILTER (WHERE completed))::BIGINT AS scores,
             (SELECT CAST(game_id AS VARCHAR) FROM games WHERE completed ORDER BY season DESC, week DESC, kickoff DESC, game_id DESC LIMIT 1) AS last_game_id
      FROM games)""")
def _(fx):
    return ST.run_fingerprint(fx.games).select("completed_games", "last_game_id", "end_season", "run_id")
