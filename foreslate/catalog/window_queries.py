"""W-rows: prior-only windows and sequential state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import rating as RT
from ..operators import reshape as U
from ..operators.scans import (
    bias_corrected_mean, center, decayed_scan, decayed_sum, ewma, prior_baseline,
)
from ..plans import passers as P
from ..plans import players as PL
from ..plans import reports as RP
from . import frames as R
from .registry import query
from .shared_sql import ewma_prior, mean_prior

ROLL = list(K.ROLLED_STATS)


@query("w1_prior_baseline", floats=" ".join(ROLL), ints="season", views="baselines",
       sql=f"SELECT season, {', '.join(ROLL)} FROM baselines")
def _(fx):
    return prior_baseline(R.observed(fx), ROLL)


@query("w2_center", floats=" ".join(ROLL), ints="game_id", views="centered",
       sql=f"SELECT game_id, team, {', '.join(ROLL)} FROM centered")
def _(fx):
    return center(R.observed(fx), ROLL).select("game_id", "team", *ROLL)


@query("w3_pregame_average", floats=" ".join(f"{s}__s" for s in ROLL), ints="game_id", views="in_season",
       sql=f"SELECT game_id, team, {', '.join(f'now_{s} AS {s}__s' for s in ROLL)} FROM in_season")
def _(fx):
    rolled = decayed_scan(
        center(R.observed(fx), ROLL), entity=["team"], restart=["season"], order=["week", "kickoff", "game_id", "is_home"],
        values={s: ewma(K.FORM_ALPHA) for s in ROLL})
    return rolled.select("game_id", "team", *[f"{s}__s" for s in ROLL])


@query("w3_pregame_average_events", floats="value average", ints="event_id seen", views="log",
       sql=f"""SELECT entity, event_id, value,
              {ewma_prior('value', K.FORM_ALPHA, 'PARTITION BY entity, season ORDER BY ts, event_id')} AS average,
              count(value) OVER (PARTITION BY entity, season ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
              FROM log""")
def _(fx):
    rolled = decayed_scan(fx.events, entity=["entity"], restart=["season"], order=["ts", "event_id"],
                          values={"value": ewma(K.FORM_ALPHA)})
    return rolled.select("entity", "event_id", "value", F.col("value__s").alias("average"),
                         F.col("value__n").alias("seen"))


@query("w4_blended_form", floats=" ".join(ROLL), ints="game_id", views="form",
       sql=f"SELECT game_id, team, {', '.join(ROLL)} FROM form")
def _(fx):
    return R.form(fx).select("game_id", "team", *ROLL)


@query("w5_form_games", ints="game_id form_games", views="in_season",
       sql="SELECT game_id, team, form_games FROM in_season")
def _(fx):
    return R.form(fx).select("game_id", "team", "form_games")


@query("w6_rating_pass", ints="game_id", floats="elo_home_pre elo_away_pre elo_diff elo_raw_diff elo_hfa_points "
       "elo_rest_points elo_qb_points elo_prob_home elo_spread", views="rated", sql="SELECT * FROM rated")
def _(fx):
    return RT.rating_pass(fx.games)[0]


@query("w7_home_advantage", floats="hfa", ints="season", views="hfa", sql="SELECT league, season, hfa FROM hfa")
def _(fx):
    return RT.home_advantage(fx.games)


@query("w8_rest_points", floats="rest_points", ints="game_id", views="games",
       sql="""SELECT game_id, CASE WHEN home_rest - away_rest > 10 THEN 1.0 WHEN home_rest - away_rest < -10 THEN -1.0
              ELSE coalesce(home_rest - away_rest, 0) * 0.10 END AS rest_points FROM games""")
def _(fx):
    return fx.games.select("game_id", S.rest_points(F.col("home_rest"), F.col("away_rest")).alias("rest_points"))


@query("w9_rating_with_passers", ints="game_id", floats="elo_home_pre elo_away_pre elo_diff elo_raw_diff "
       "elo_hfa_points elo_rest_points elo_qb_points elo_prob_home elo_spread")
def _(fx):
    return RT.rating_pass(fx.games, R.team_games(fx), RT.RatingOptions(use_passer=True))[0]


@query("w10_current_ratings", floats="elo spread_vs_average", views="final_ratings", sql="SELECT * FROM final_ratings")
def _(fx):
    return RT.current_ratings(RT.rating_pass(fx.games)[1])


@query("w11_passer_ratings", floats="qb_rating_pre qb_rating_post qb_dropbacks_pre", ints="player_id game_id period",
       views="passer_ratings",
       sql="SELECT player_id, game_id, team, period, qb_rating_pre, qb_rating_post, qb_dropbacks_pre FROM passer_ratings")
def _(fx):
    return P.passer_ratings(R.player_weeks(fx), 1).select(
        "player_id", "game_id", "team", "period", "qb_rating_pre", "qb_rating_post", "qb_dropbacks_pre")


@query("w12_team_passer_baseline", floats="qb_rating_pre team_qb_baseline", ints="game_id", views="starter_base",
       sql="SELECT game_id, team, qb_rating_pre, team_qb_baseline FROM starter_base")
def _(fx):
    starters = P.starter_ratings(fx.games, P.passer_ratings(R.player_weeks(fx), 1))
    return P.team_passer_baseline(starters).select("game_id", "team", "qb_rating_pre", "team_qb_baseline")


@query("w13_passer_features", floats="qb_delta qb_edge", ints="game_id", views="passer_terms",
       sql="SELECT game_id, qb_delta, qb_edge FROM passer_terms")
def _(fx):
    return P.passer_features(fx.games, R.player_weeks(fx), 1)


@query("w14_expanding_usage", floats="touches usage_post", ints="player_id game_id period", views="usage",
       sql="SELECT player_id, game_id, team, period, touches, usage_post FROM usage")
def _(fx):
    return P.player_usage(R.player_weeks(fx)).select(
        "player_id", "game_id", "team", "period", "touches", "usage_post")


@query("w15_availability_edge", floats="availability_edge", ints="game_id", views="availability_terms",
       sql="SELECT game_id, availability_edge FROM availability_terms")
def _(fx):
    return P.availability_features(fx.games, R.player_weeks(fx), R.injuries(fx))


FORM = ["form_pass_yards", "form_attempts", "form_rush_yards", "form_carries", "form_rec_yards", "form_targets"]


@query("w16_player_form", floats=" ".join(FORM), ints="player_id game_id", views="player_rolled",
       sql=f"SELECT player_id, game_id, team, {', '.join(FORM)} FROM player_rolled")
def _(fx):
    return PL.player_form(R.player_weeks(fx)).select("player_id", "game_id", "team", *FORM)


@query("w16_weighted_mean_events", floats="mean", ints="event_id", views="log",
       sql=f"""SELECT entity, event_id,
              {mean_prior('coalesce(value, 0)', K.PLAYER_ALPHA, 'PARTITION BY entity ORDER BY ts, event_id')} AS mean
              FROM log""")
def _(fx):
    rolled = decayed_scan(fx.events.fillna(0.0, ["value"]), entity=["entity"], order=["ts", "event_id"],
                          values={"value": decayed_sum(K.PLAYER_ALPHA)})
    return rolled.select("entity", "event_id", bias_corrected_mean("value", K.PLAYER_ALPHA).alias("mean"))


@query("w17_defence_form", floats="opp_pass_yards_allowed opp_rush_yards_allowed", ints="season week",
       views="allowed_form", sql="SELECT * FROM allowed_form")
def _(fx):
    return PL.defence_form(R.player_weeks(fx))


RATES = ["form_pass_ypa", "form_rush_ypc", "form_rec_ypt"]


@query("w18_efficiency", floats=" ".join(RATES), ints="player_id game_id", views="player_rates",
       sql=f"SELECT player_id, game_id, team, {', '.join(RATES)} FROM player_rates")
def _(fx):
    return PL.efficiency(PL.player_form(R.player_weeks(fx))).select("player_id", "game_id", "team", *RATES)


@query("w19_prior_appearances", ints="player_id game_id form_games", views="player_weeks",
       sql="""SELECT player_id, game_id, team, row_number() OVER (
              PARTITION BY player_id ORDER BY season, week, game_id, team) - 1 AS form_games FROM player_weeks""")
def _(fx):
    return PL.player_form(R.player_weeks(fx)).select("player_id", "game_id", "team", "form_games")


@query("w20_trailing_games", floats="points_for points_against", ints="games", views="team_table",
       sql="SELECT team, games, points_for, points_against FROM team_table")
def _(fx):
    return U.trailing_team_table(fx.games)


@query("w21_rank_in_market", floats="strength", ints="game_id season week rank", views="picks",
       sql="SELECT game_id, season, week, market, strength, rank FROM picks")
def _(fx):
    return RP.ranked_picks(R.priced(fx)).select("game_id", "season", "week", "market", "strength", "rank")
