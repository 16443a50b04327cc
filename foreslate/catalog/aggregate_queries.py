"""A-rows: reductions and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import aggregates as A
from ..operators import grading as G
from ..plans import features as FT
from ..plans import passers as P
from ..plans import players as PL
from ..plans import reports as RP
from . import frames as R
from .registry import query
from .shared_sql import (
    SUMMARY, calibration_sql, floored, hit, metrics_sql, record_sql, regression_sql, scorecard_sql,
)

_OFF = [f"off_{s}" for s in SUMMARY]
_DEF = [f"def_{s}" for s in SUMMARY]


@query("a1_team_game_summary", floats=" ".join(_OFF), ints="game_id season week", views="offence",
       sql=f"SELECT game_id, season, week, team, {', '.join(_OFF)} FROM offence")
def _(fx):
    plays = A.play_outcomes(A.coerce_flags(A.scrimmage_plays(R.flagged_plays(fx))))
    return A.offence_summary(plays).select("game_id", "season", "week", "team", *_OFF)


@query("a2_minimum_plays", floats="off_plays", ints="game_id", views="offence",
       sql="SELECT game_id, team, off_plays FROM offence WHERE off_plays >= 2")
def _(fx):
    plays = A.play_outcomes(A.coerce_flags(A.scrimmage_plays(R.flagged_plays(fx))))
    return A.offence_summary(plays).where("off_plays >= 2").select("game_id", "team", "off_plays")


@query("a3_first_opponent", ints="game_id", views="scrimmage",
       sql="SELECT game_id, posteam AS team, arg_min(defteam, seq) AS opponent FROM scrimmage GROUP BY game_id, posteam")
def _(fx):
    return A.scrimmage_plays(fx.plays).groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.min_by("defteam", "seq").alias("opponent"))


@query("a4_half_scores", floats="home_first_half away_first_half", ints="game_id season", views="halves",
       sql="SELECT game_id, season, home_first_half, away_first_half FROM halves")
def _(fx):
    return A.half_scores(R.scored_plays(fx))


@query("a5_season_sums_counts", floats="epa_sum pass_sum", ints="season epa_n pass_n", views="team_games",
       sql="""SELECT season, sum(off_epa_play) AS epa_sum, count(off_epa_play) AS epa_n,
              sum(off_pass_epa) AS pass_sum, count(off_pass_epa) AS pass_n FROM team_games GROUP BY season""")
def _(fx):
    return R.team_games(fx).groupBy("season").agg(
        F.sum("off_epa_play").alias("epa_sum"), F.count("off_epa_play").alias("epa_n"),
        F.sum("off_pass_epa").alias("pass_sum"), F.count("off_pass_epa").alias("pass_n"))


@query("a6_defence_allowed", floats="pass_yards_allowed rush_yards_allowed", ints="season week",
       views="player_weeks",
       sql="""SELECT opponent_team AS team, season, week, coalesce(sum(passing_yards), 0) AS pass_yards_allowed,
              coalesce(sum(rushing_yards), 0) AS rush_yards_allowed FROM player_weeks
              GROUP BY opponent_team, season, week""")
def _(fx):
    return A.defence_allowed(R.player_weeks(fx))


@query("a7_team_usage", floats="team_usage", ints="period", views="team_timeline",
       sql="SELECT team, period, team_usage FROM team_timeline")
def _(fx):
    return P.player_usage(R.player_weeks(fx)).groupBy("team", "period").agg(
        F.sum("usage_post").alias("team_usage"))


@query("a8_absence_cost", floats="missing team_usage cost", ints="season week", views="absence",
       sql="SELECT season, week, team, missing, team_usage, cost FROM absence")
def _(fx):
    usage = P.player_usage(R.player_weeks(fx))
    return P.absence_cost(usage, R.injuries(fx)).drop("period")


@query("a9_appearances", ints="player_id appearances", views="player_weeks",
       sql="SELECT player_id, team, count(*) AS appearances FROM player_weeks GROUP BY player_id, team HAVING count(*) >= 1")
def _(fx):
    return fx.player_weeks.groupBy("player_id", "team").agg(F.count("*").alias("appearances")).where(
        F.col("appearances") >= K.ROSTER_MIN_APPEARANCES)


METRICS = "accuracy brier log_loss mean_prob"


@query("a10_probability_metrics", floats=METRICS, ints="n", views="scored",
       sql=metrics_sql("scored", "prob_home"))
def _(fx):
    return G.probability_metrics(R.scored(fx))


@query("a11_calibration", floats="low high predicted actual gap", ints="games", views="scored",
       sql=calibration_sql("scored", "prob_home", K.CALIBRATION_EDGES))
def _(fx):
    return G.calibration_table(R.scored(fx))


RECORD = "threshold win_rate roi units breakeven"
RECORD_INTS = "bets wins losses pushes"
ATS_WHERE = "home_win IS NOT NULL AND market_spread IS NOT NULL AND pred_margin IS NOT NULL"
OU_WHERE = "actual_total IS NOT NULL AND market_total IS NOT NULL AND model_total IS NOT NULL"
ATS_SQL = ("scored", "(pred_margin - market_spread)", "margin - market_spread")
OU_SQL = ("scored", "(model_total - market_total)", "actual_total - market_total")


@query("a12_spread_record", floats=RECORD, ints=RECORD_INTS, views="scored",
       sql=record_sql(*ATS_SQL, [0.5], ATS_WHERE))
def _(fx):
    return G.spread_record(R.scored(fx), thresholds=[0.5])


@query("a13_threshold_ladder", floats=RECORD, ints=RECORD_INTS, views="scored",
       sql=f"SELECT 'spread' AS market, * FROM ({record_sql(*ATS_SQL, K.ATS_THRESHOLDS, ATS_WHERE)}) "
           f"UNION ALL SELECT 'total', * FROM ({record_sql(*OU_SQL, K.OU_THRESHOLDS, OU_WHERE)})")
def _(fx):
    spread = G.spread_record(R.scored(fx)).withColumn("market", F.lit("spread"))
    return spread.unionByName(G.total_record(R.scored(fx)).withColumn("market", F.lit("total")))


@query("a14_regression_metrics", floats="mae rmse bias mean_total", ints="n", views="scored",
       sql=regression_sql("scored", "pred_total"))
def _(fx):
    return G.regression_metrics(R.scored(fx))


@query("a15_total_record", floats=RECORD, ints=RECORD_INTS, views="scored",
       sql=record_sql(*OU_SQL, [2.0], OU_WHERE))
def _(fx):
    return G.total_record(R.scored(fx), thresholds=[2.0])


METHOD_UNION = "UNION ALL".join(
    f" SELECT '{m}' AS method, * FROM ({metrics_sql('scored', p)}) " for m, p in G.WINNER_METHODS
) + """UNION ALL SELECT 'home_team_always', count(*), avg(home_win), NULL, NULL, NULL
       FROM scored WHERE home_win IS NOT NULL"""


@query("a16_method_comparison", floats=METRICS, ints="n", views="scored", sql=METHOD_UNION)
def _(fx):
    return G.method_comparison(R.scored(fx))


SEASON_SQL = f"""count(*) AS games, avg({hit('prob_home')}) AS accuracy,
    avg(pow({floored('prob_home')} - home_win, 2)) AS brier FROM scored WHERE completed"""


@query("a17_by_season", floats="accuracy brier", ints="season games", views="scored",
       sql=f"SELECT season, {SEASON_SQL} GROUP BY season")
def _(fx):
    return G.by_season(R.settled(fx))


@query("a18_by_season_with_total", floats="accuracy brier", ints="games", views="scored",
       sql=f"SELECT coalesce(CAST(season AS VARCHAR), 'All') AS season, {SEASON_SQL} GROUP BY ROLLUP (season)")
def _(fx):
    log = G.game_log(R.settled(fx))
    return log.rollup("season").agg(
        F.count("*").alias("games"), F.avg("hit_blended").alias("accuracy"),
        F.avg("brier_blended").alias("brier"),
    ).withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("All")))


CARD_FLOATS = "correct accuracy brier ats_wins ou_wins total_mae market_total_mae ats_rate ou_rate"
CARD_INTS = "games ats_played ou_played"


@query("a19_weekly_scorecard", floats=CARD_FLOATS, ints=f"season week {CARD_INTS}", views="graded",
       sql=scorecard_sql("graded", "season, week", "season, week"))
def _(fx):
    return G.scorecard(R.graded(fx), ["season", "week"])


@query("a20_season_summary", floats=CARD_FLOATS, ints=CARD_INTS, views="graded",
       sql=scorecard_sql("graded", "coalesce(CAST(week AS VARCHAR), 'All') AS week", "ROLLUP (week)"))
def _(fx):
    return G.scorecard(R.graded(fx), ["week"], rollup=True).withColumn(
        "week", F.coalesce(F.col("week").cast("string"), F.lit("All")))


@query("a21_against_long_run", floats="this_season long_run", ints="season", views="graded",
       sql=f"SELECT season, measure, this_season, long_run FROM ({scorecard_sql('graded', 'season', 'season')}) s, "
           "LATERAL (VALUES " + ", ".join(
               f"('{label}', {column}, {value})" for label, column, value in K.LONG_RUN
           ) + ") m(measure, this_season, long_run)")
def _(fx):
    return RP.against_long_run(G.scorecard(R.graded(fx), ["season"]), ["season"])


@query("a22_fit_report", floats="sigma train_mae", ints="n_train", views="scored",
       sql="""SELECT count(*) AS n_train, string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons,
              stddev_pop(actual_total - model_total) AS sigma, avg(abs(actual_total - model_total)) AS train_mae
              FROM scored WHERE completed""")
def _(fx):
    return A.fit_facts(R.settled(fx), F.col("model_total"), F.col("actual_total"))


@query("a23_slate_headline", floats="pick_prob pred_total", ints="season week games coinflips", views="edges",
       sql="""
SELECT season, week, count(*) AS games, count(*) FILTER (WHERE pick_prob < 0.575) AS coinflips,
       max(CASE WHEN rb = 1 THEN pick || ' over ' || CASE WHEN pick = home_team THEN away_team ELSE home_team END END) AS best_pick,
       max(pick_prob) AS pick_prob,
       max(CASE WHEN rt = 1 THEN away_team || ' @ ' || home_team END) AS highest_total, max(pred_total) AS pred_total
FROM (SELECT *, row_number() OVER (PARTITION BY season, week ORDER BY round(pick_prob, 9) DESC, game_id) AS rb,
             row_number() OVER (PARTITION BY season, week ORDER BY round(pred_total, 9) DESC, game_id) AS rt FROM edges)
GROUP BY season, week""")
def _(fx):
    return RP.slate_headline(R.priced(fx))


@query("a24_history_note", ints="season games first_week last_week", views="games",
       sql="""SELECT season, count(*) AS games, min(week) AS first_week, max(week) AS last_week
              FROM games WHERE completed GROUP BY season""")
def _(fx):
    return RP.history_note(fx.games)


@query("a25_last_week_record", floats="correct ats_wins ou_wins", ints="season week games ats_played ou_played",
       views="graded",
       sql="""SELECT season, week, count(*) AS games, sum(hit) AS correct, coalesce(sum(ats_win), 0) AS ats_wins,
              count(ats_win) AS ats_played, coalesce(sum(ou_win), 0) AS ou_wins, count(ou_win) AS ou_played
              FROM graded g WHERE week = (SELECT max(week) FROM graded m WHERE m.season = g.season)
              GROUP BY season, week""")
def _(fx):
    return G.scorecard(RP.last_settled_week(R.graded(fx)), ["season", "week"]).select(
        "season", "week", "games", "correct", "ats_wins", "ats_played", "ou_wins", "ou_played")


@query("a26_data_summary", ints="games completed", views="games",
       sql="SELECT count(*) AS games, count(*) FILTER (WHERE completed) AS completed FROM games")
def _(fx):
    return fx.games.agg(F.count("*").alias("games"), F.count_if("completed").alias("completed"))


_NAIVE = """
WITH r AS ({rows}), s AS (SELECT season, sum(actual) AS t, count(actual) AS n FROM r GROUP BY season),
b AS (SELECT season, coalesce(sum(t) OVER w / sum(n) OVER w, t / n) AS mean FROM s
      WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, count(*) AS games, avg(abs(actual - model)) AS model_mae, avg(abs(actual - mean)) AS mean_mae,
       avg(abs(actual - own)) AS own_mae
FROM r JOIN b USING (season) GROUP BY season"""


@query("a27_naive_baselines", floats="model_mae mean_mae own_mae", ints="season games", views="scored paired", sql=_NAIVE.format(rows="""
  SELECT s.season, s.actual_total AS actual, s.model_total AS model,
         (coalesce(p.home_points_for, 0) + coalesce(p.away_points_for, 0)
          + coalesce(p.home_points_against, 0) + coalesce(p.away_points_against, 0)) / 2.0 AS own
  FROM scored s JOIN paired p USING (game_id) WHERE s.completed"""))
def _(fx):
    own = R.paired_on(fx, ("points_for", "points_against")).select("game_id", FT.pair_sums()["scoring_sum"].alias("own"))
    return RP.naive_comparison(R.settled(fx).join(own, "game_id"), "actual_total", "model_total", "own")


@query("a27_player_baselines", floats="model_mae mean_mae own_mae", ints="season games", views="player_rolled", sql=_NAIVE.format(rows="""
  SELECT season, passing_yards AS actual, form_pass_yards * 0.9 AS model, form_pass_yards AS own FROM player_rolled
  WHERE passing_yards IS NOT NULL"""))
def _(fx):
    rows = PL.player_form(R.player_weeks(fx)).where("passing_yards is not null")
    return RP.naive_comparison(rows.withColumn("model", F.col("form_pass_yards") * 0.9), "passing_yards", "model", "form_pass_yards")
