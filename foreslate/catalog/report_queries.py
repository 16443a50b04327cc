"""R-rows: picks, grades and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import grading as G
from ..operators import rating as RT
from ..operators import reshape as U
from ..plans import models as M
from ..plans import players as PL
from ..plans import reports as RP
from . import frames as R
from .aggregate_queries import ATS_SQL, ATS_WHERE, OU_SQL, OU_WHERE, RECORD, RECORD_INTS
from .registry import query
from .shared_sql import label, phi, record_sql

EDGE_FLOATS = "pick_prob spread_edge fair_home_ml fair_away_ml pick_odds ml_ev kelly"
EDGE_TEXT = ["pick", "confidence", "ats_pick", "disagrees_with_market"]


@query("r1_picks_and_edges", floats=EDGE_FLOATS, ints="game_id", views="priced",
       sql=f"SELECT game_id, {', '.join(EDGE_TEXT)}, {EDGE_FLOATS.replace(' ', ', ')} FROM priced")
def _(fx):
    return G.attach_edges(R.scored(fx)).select("game_id", *EDGE_TEXT, *EDGE_FLOATS.split())


@query("r2_grading", floats="pick_prob hit ats_win ou_win total_error", ints="game_id", views="graded",
       sql="SELECT game_id, pick, pick_prob, hit, ats_win, ou_win, ou_pick, total_error FROM graded")
def _(fx):
    return G.grade(R.settled(fx)).select(
        "game_id", "pick", "pick_prob", "hit", "ats_win", "ou_win", "ou_pick", "total_error")


LOG_FLOATS = " ".join(
    [f"{k}_{n}" for n, _ in G.WINNER_METHODS for k in ("hit", "brier")]
    + [f"{k}_total_{n}" for n, _ in G.TOTAL_METHODS for k in ("err", "signed")]
    + ["confidence", "spread_edge", "abs_edge", "ou_edge"])


@query("r3_game_log", floats=LOG_FLOATS, ints="game_id", views="gamelog",
       sql="SELECT game_id, ats_result, ou_result, "
           + ", ".join("game_confidence AS confidence" if c == "confidence" else c for c in LOG_FLOATS.split())
           + " FROM gamelog")
def _(fx):
    return G.game_log(R.settled(fx)).select("game_id", "ats_result", "ou_result", *LOG_FLOATS.split())


@query("r4_method_summary", floats="accuracy brier", ints="games", views="gamelog", sql="UNION ALL ".join(
    f"SELECT '{n}' AS method, count(hit_{n}) AS games, avg(hit_{n}) AS accuracy, avg(brier_{n}) AS brier FROM gamelog "
    for n, _ in G.WINNER_METHODS)
    + "UNION ALL SELECT 'home_team_always', count(home_win), avg(home_win), NULL FROM gamelog")
def _(fx):
    return RP.method_summary(G.game_log(R.settled(fx)))


_BANDS = ", ".join(f"({lo}, {hi})" for lo, hi in zip(K.CALIBRATION_EDGES, K.CALIBRATION_EDGES[1:]))


@query("r5_calibration_bands", floats="low high said actual gap", ints="games", views="gamelog", sql=f"""
SELECT low, high, count(g.game_id) AS games, avg(game_confidence) AS said, avg(hit_blended) AS actual,
       avg(hit_blended) - avg(game_confidence) AS gap
FROM (VALUES {_BANDS}) b(low, high) LEFT JOIN gamelog g ON game_confidence > low AND game_confidence <= high GROUP BY low, high""")
def _(fx):
    return RP.calibration_bands(G.game_log(R.settled(fx)))


@query("r6_spread_ladder", floats=RECORD, ints=RECORD_INTS, views="scored",
       sql=record_sql(*ATS_SQL, K.ATS_THRESHOLDS, ATS_WHERE, pay=1.05))
def _(fx):
    return RP.spread_ladder(G.game_log(R.settled(fx)), odds=105)


@query("r7_totals_backtest", floats="mae rmse bias win_rate roi", ints="games wins losses pushes", views="gamelog scored",
       sql="UNION ALL ".join(
           f"SELECT 'error' AS section, '{n}' AS name, count(err_total_{n}) AS games, avg(err_total_{n}) AS mae, "
           f"sqrt(avg(pow(err_total_{n}, 2))) AS rmse, avg(signed_total_{n}) AS bias, "
           "NULL AS wins, NULL AS losses, NULL AS pushes, NULL AS win_rate, NULL AS roi FROM gamelog "
           for n, _ in G.TOTAL_METHODS)
       + f"UNION ALL SELECT 'record', printf('%.1f', CAST(threshold AS DOUBLE)), bets, NULL, NULL, NULL, wins, losses, pushes, win_rate, roi FROM ({record_sql(*OU_SQL, K.OU_THRESHOLDS, OU_WHERE)})")
def _(fx):
    return RP.totals_backtest(G.game_log(R.settled(fx)))


@query("r8_slate_table", floats="pick_prob model line edge market_prob fair_ml book_ml ev", ints="game_id season week",
       views="priced", sql="""
SELECT game_id, season, week, away_team, home_team, pick, pick_prob, confidence, pred_margin AS model, market_spread AS line,
       spread_edge AS edge, CASE WHEN prob_home >= 0.5 THEN market_prob_home ELSE 1.0 - market_prob_home END AS market_prob,
       CASE WHEN margin IS NULL THEN '' WHEN margin = 0 THEN 'PUSH' WHEN (prob_home >= 0.5) = (margin > 0) THEN 'HIT' ELSE 'MISS' END AS outcome,
       -100.0 * least(pick_prob, 0.999999) / (1.0 - least(pick_prob, 0.999999)) AS fair_ml, pick_odds AS book_ml, ml_ev AS ev, disagrees_with_market FROM priced""")
def _(fx):
    return RP.slate_table(R.priced(fx))


_NEED = "(CASE WHEN market_total % 1.0 = 0 THEN market_total + 0.5 ELSE market_total END)"


@query("r9_totals_table", floats="model line projection edge prob_over prob_push", ints="game_id season week", views="priced",
       sql=f"""
SELECT game_id, season, week, away_team, home_team, ou_pick AS pick, model_total AS model, market_total AS line, pred_total AS projection,
       model_edge AS edge, prob_over, prob_push,
       {label("(CASE WHEN ou_pick = 'OVER' THEN prob_over ELSE 1.0 - prob_over END)", K.CONFIDENCE_TIERS, "'-'")} AS confidence,
       CASE WHEN actual_total IS NULL OR market_total IS NULL THEN '' WHEN actual_total = market_total THEN 'PUSH'
            WHEN (actual_total > market_total) = (ou_pick = 'OVER') THEN 'HIT' ELSE 'MISS' END AS outcome
FROM (SELECT *, CASE WHEN market_total IS NOT NULL THEN 1.0 - {phi(f'(({_NEED} - pred_total) / 13.3)')} END AS prob_over,
             CASE WHEN market_total % 1.0 = 0 THEN {phi('((market_total + 0.5 - pred_total) / 13.3)')} - {phi('((market_total - 0.5 - pred_total) / 13.3)')} ELSE 0 END AS prob_push
      FROM priced)""")
def _(fx):
    return RP.totals_table(R.priced(fx))


SPLIT_FLOATS = ("away_team_total home_team_total pred_total first_half_total_pred first_half_margin_pred "
                "second_half_total_pred second_half_margin_pred")


@query("r10_splits_table", floats=SPLIT_FLOATS, ints="game_id season week", views="halved", sql="""
SELECT game_id, season, week, away_team, home_team, away_team_total, home_team_total, pred_total, first_half_total_pred,
       first_half_margin_pred, pred_total - first_half_total_pred AS second_half_total_pred,
       pred_margin - first_half_margin_pred AS second_half_margin_pred FROM halved""")
def _(fx):
    return RP.splits_table(M.predict_halves(R.halved(fx), M.fit_halves(R.halved(fx))))


@query("r11_player_table", floats="value availability", ints="player_id rank", views="player_rolled one_listing", sql="UNION ALL ".join(
    f"""SELECT player_id, team, availability, category, value, rank,
        CASE WHEN availability >= 0.999 THEN 'available' ELSE 'listed (' || printf('%.0f', availability * 100) || '%)' END AS status
        FROM (SELECT *, row_number() OVER (ORDER BY round(value, 9) DESC, player_id, team) AS rank FROM (
          SELECT p.player_id, p.team, coalesce(max(r.availability), 1) AS availability, 'proj_{t}' AS category, max({f}) AS value
          FROM player_rolled p LEFT JOIN one_listing r ON r.season = p.season AND r.week = p.week AND r.player_id = p.player_id
          GROUP BY p.player_id, p.team) WHERE value > 0) WHERE rank <= 20 """
    for t, f in (("passing_yards", "form_pass_yards"), ("rushing_yards", "form_rush_yards"), ("receiving_yards", "form_rec_yards"))))
def _(fx):
    # pregame form stands in for the fitted projection, so the table has exact numbers
    form = PL.attach_availability(PL.player_form(R.player_weeks(fx)), R.injuries(fx))
    listed = R.injuries(fx).select("season", "week", F.col("gsis_id").alias("player_id")).distinct().withColumn(
        "listed", F.lit(True))
    form = form.join(listed, ["season", "week", "player_id"], "left")
    best = form.groupBy("player_id", "team").agg(
        F.coalesce(F.max(F.when(F.col("listed"), F.col("availability"))), F.lit(1.0)).alias("availability"),
        F.max("form_pass_yards").alias("proj_passing_yards"),
        F.max("form_rush_yards").alias("proj_rushing_yards"),
        F.max("form_rec_yards").alias("proj_receiving_yards"))
    return RP.player_table(best, 20)


@query("r12_ranked_picks", floats="strength model line edge win_prob band_rate ev",
       ints="game_id season week band_games rank", views="picks", sql="SELECT * FROM picks")
def _(fx):
    return RP.ranked_picks(R.priced(fx))


@query("r13_spread_table", floats="line model edge", ints="game_id season week", views="scored", sql="""
SELECT game_id, season, week, away_team, home_team, market_spread AS line, pred_margin AS model, pred_margin - market_spread AS edge,
       CASE WHEN market_spread IS NULL THEN '-' WHEN pred_margin > market_spread THEN home_team ELSE away_team END AS model_likes FROM scored""")
def _(fx):
    return RP.spread_table(R.scored(fx))


def _word(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = 1 THEN 'WON' WHEN {c} = 0 THEN 'LOST' ELSE 'PUSH' END"


@query("r14_last_week", floats="spread total", ints="game_id season week", views="graded", sql=f"""
SELECT game_id, season, week, away_team, home_team, printf('%.0f', away_score) || '-' || printf('%.0f', home_score) AS score, pick,
       {_word('hit')} AS won, market_spread AS spread, {_word('ats_win')} AS covered, market_total AS total,
       CASE WHEN ou_win IS NULL THEN '' ELSE upper(ou_pick[1]) || lower(ou_pick[2:]) || ' — ' || lower({_word('ou_win')}) END AS over_under
FROM graded g WHERE week = (SELECT max(week) FROM graded m WHERE m.season = g.season)""")
def _(fx):
    return RP.last_week_table(R.graded(fx))


@query("r15_ratings_table", floats="elo spread_vs_average", ints="rank", views="final_ratings",
       sql="SELECT *, row_number() OVER (PARTITION BY league ORDER BY elo DESC, team) AS rank FROM final_ratings")
def _(fx):
    return RP.ratings_table(RT.current_ratings(RT.rating_pass(fx.games)[1]))


@query("r16_team_data", floats="points_for points_against elo spread_vs_average", ints="games",
       views="team_table stand_in_elo", sql="""
SELECT t.team, t.games, t.points_for, t.points_against, e.elo, e.spread_vs_average FROM team_table t LEFT JOIN stand_in_elo e USING (team)""")
def _(fx):
    return RP.team_data(U.trailing_team_table(fx.games), R.elo(fx))


@query("r17_user_picks", ints="game_id season week", views="edges", sql="""
SELECT game_id, season, week, pick,
       CASE WHEN margin IS NULL THEN '' WHEN margin = 0 THEN 'PUSH' WHEN (prob_home >= 0.5) = (margin > 0) THEN 'HIT' ELSE 'MISS' END AS outcome,
       user_pick, CASE WHEN user_pick IS NULL OR margin IS NULL THEN '' WHEN margin = 0 THEN 'PUSH'
       WHEN (user_pick = home_team) = (margin > 0) THEN 'HIT' ELSE 'MISS' END AS user_outcome
FROM (SELECT *, CASE WHEN game_id % 2 = 0 THEN CASE WHEN game_id % 3 = 0 THEN away_team ELSE home_team END END AS user_pick FROM edges)""")
def _(fx):
    mine = F.when(F.col("game_id") % 3 == 0, F.col("away_team")).otherwise(F.col("home_team"))
    picks = fx.games.where("game_id % 2 = 0").select("game_id", mine.alias("user_pick"))
    return RP.user_pick_table(R.priced(fx), picks)
