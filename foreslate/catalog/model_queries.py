"""M-rows: fits, forecasts and replays.

Tree fits have no SQL form and are checked for rows here and against a plain twin
in the tests; ridges and one-feature logistic curves have theirs, and the arithmetic around all of them is checked
exactly on the stand-in forecasts.  Fits use the library's own rounds and history minimums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import grading as G
from ..plans import features as FT
from ..plans import models as M
from ..plans import walkforward as WF
from ..sources import readers as RD
from ..sources.store import materialize, scratch_path
from . import frames as R
from . import projection_queries  # noqa: F401 - registers the parts of the feature table
from .registry import REGISTRY, query
from .shared_sql import implied, logit, phi

OPTIONS = WF.ReplayOptions()


def _coefficients(fx, rows) -> DataFrame:
    return fx.spark.createDataFrame(rows, "feature string, coefficient double")


@R.shared
def history(fx) -> DataFrame:
    return R.model_inputs(fx).where("completed AND season < 2001")


@R.shared
def next_season(fx) -> DataFrame:
    return R.model_inputs(fx).where("completed AND season = 2001")


@R.shared
def winner(fx) -> M.WinnerModel:
    return M.fit_winner(history(fx))


@R.shared
def total(fx) -> M.TotalModel:
    return M.fit_total(history(fx))


@R.shared
def replay(fx) -> DataFrame:
    return materialize(WF.walk_forward(R.model_inputs(fx), 1997, refit="season", options=OPTIONS), "replay")


FEATURES = list(dict.fromkeys(K.WINNER_FEATURES + K.PASSER_FEATURES + K.TOTAL_FEATURES))
FEATURE_SQL = f"""
SELECT g.game_id, {', '.join(f'coalesce({f}, 0) AS {f}' for f in FEATURES)}
FROM games AS g LEFT JOIN (SELECT game_id, elo_diff FROM rated) AS rated ON rated.game_id = g.game_id
""".replace("FROM games AS g", "FROM (SELECT game_id FROM games) AS g") + "".join(
    f"LEFT JOIN ({part}) AS part_{i} ON part_{i}.game_id = g.game_id\n" for i, part in enumerate((
        REGISTRY["p13_matchup_edges"].sql, REGISTRY["p14_situation"].sql, REGISTRY["p15_pair_sums"].sql,
        REGISTRY["p16_weather"].sql, "SELECT * FROM passer_terms", "SELECT * FROM availability_terms")))
FEATURE_VIEWS = "games rated paired passer_terms availability_terms"


@query("feature_table", ints="game_id", floats=" ".join(FEATURES), views=FEATURE_VIEWS, sql=FEATURE_SQL)
def _(fx):
    return R.model_inputs(fx).select("game_id", *FEATURES)


@query("feature_table_from_files", ints="game_id", floats=" ".join(FEATURES), views=FEATURE_VIEWS, sql=FEATURE_SQL)
def _(fx):
    """Landed text files, through the readers, to the feature table."""
    text = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")  # noqa: E731 - sorts as the number does

    def landed(df: DataFrame, name: str) -> str:
        path = scratch_path(fx.spark, name) + ".csv"
        df.withColumn("game_id", text("game_id")).write.option("header", True).csv(path)
        return path

    log = fx.games.withColumns({
        "game_type": F.when(F.col("is_playoff"), "POST").otherwise("REG"),
        "gameday": F.date_format("kickoff", "yyyy-MM-dd"), "gametime": F.date_format("kickoff", "HH:mm"),
        "result": F.when(F.col("completed"), F.col("margin")), "location": F.when(F.col("neutral"), "Neutral").otherwise("Home"),
        "div_game": F.col("div_game").cast("int"),
    })
    games = RD.load_games(fx.spark, landed(log, "games"), {})
    plays = RD.load_plays(fx.spark, landed(R.flagged_plays(fx), "plays"), first=0, mapping={})
    players = RD.load_player_weeks(fx.spark, landed(fx.player_weeks, "players"), first=0, mapping={})
    reports = RD.load_injuries(fx.spark, landed(fx.injuries.withColumn("game_id", F.lit(0)), "reports"), first=0, mapping={})
    team_games = materialize(A.team_games(plays, min_plays=1), "team-games")
    return FT.build_features(games, team_games, players, reports, min_dropbacks=1, sides=False).select("game_id", *FEATURES)


@query("m1_winner_logistic", floats="coefficient")
def _(fx):
    features = [*K.WINNER_FEATURES, *K.PASSER_FEATURES]
    b0, b = M.winner_curve(M.winner_training(history(fx)), features)
    return _coefficients(fx, list(zip(["intercept", *features], [b0, *b])))


def _newton(rows: str, penalty: str, steps: int = 40) -> str:
    """Newton steps for a one-feature logistic curve as a recursive query: columns a (intercept) and b (slope)."""
    return f"""
WITH RECURSIVE r AS MATERIALIZED ({rows}), k AS MATERIALIZED (SELECT {penalty} AS pen FROM r), n AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT i, a, b, sum(p - y) AS g0, sum((p - y) * x) + pen * b AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
           sum(p * (1 - p) * x * x) + pen AS h11
    FROM (SELECT i, a, b, pen, x, y, 1.0 / (1.0 + exp(-greatest(a + b * x, -500.0))) AS p FROM n, k, r WHERE i < {steps}) AS t
    GROUP BY i, a, b, pen) AS g)"""


@query("m1_logistic_one_feature", floats="intercept slope", views="scored", sql=f"""
SELECT intercept, slope FROM ({_newton(
    "SELECT model_margin AS x, CAST(margin > 0 AS INT) AS y FROM scored WHERE completed AND margin <> 0",
    f"var_pop(x) / {K.LOGISTIC_C}")}
SELECT a AS intercept, b AS slope FROM n WHERE i = 40)""")
def _(fx):
    b0, b = M.logistic_curve(M.winner_training(R.scored(fx)), ["model_margin"], F.col("margin") > 0, K.LOGISTIC_C)
    return fx.spark.createDataFrame([(b0, b[0])], "intercept double, slope double")


@query("m2_margin_ridge", floats="intercept sigma b0 b1", ints="n_train")
def _(fx):
    fit = M.ridge_fit(M.winner_training(history(fx)), K.WINNER_FEATURES, "margin")
    return fit.select("n_train", "intercept", "sigma", F.get("beta", F.lit(0)).alias("b0"), F.get("beta", F.lit(1)).alias("b1"))


_RIDGE = f"""
SELECT CAST(n AS BIGINT) AS n_train, my - b * mx AS intercept, b AS slope, sqrt(greatest(syy - 2 * b * sxy + b * b * sxx, 0) / n) AS sigma
FROM (SELECT *, sxy / (sxx + {K.RIDGE_ALPHA} * sxx / n) AS b FROM (
  SELECT count(*) AS n, avg(margin) AS my, avg(model_margin) AS mx, count(*) * var_pop(model_margin) AS sxx,
         count(*) * var_pop(margin) AS syy, count(*) * covar_pop(margin, model_margin) AS sxy FROM scored WHERE completed AND margin <> 0))"""


@query("m2_ridge_one_feature", floats="intercept slope sigma", ints="n_train", views="scored", sql=_RIDGE)
def _(fx):
    fit = M.ridge_fit(M.winner_training(R.scored(fx)), ["model_margin"], "margin")
    return fit.select("n_train", "intercept", F.get("beta", F.lit(0)).alias("slope"), "sigma")


@query("m2_ridge_every_cutoff", floats="intercept slope", ints="period n_train", views="scored", sql=f"""
WITH p AS (SELECT season * 100 + week AS period, count(*) FILTER (WHERE completed) AS n, sum(margin) AS y, sum(model_margin) FILTER (WHERE completed) AS x,
                  sum(model_margin * model_margin) FILTER (WHERE completed) AS xx, sum(model_margin * margin) AS xy FROM scored GROUP BY 1),
c AS (SELECT period, sum(n) OVER w AS n, sum(y) OVER w AS y, sum(x) OVER w AS x, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM p
      WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT period, n, y, x, (xy - x * y / n) / ((xx - x * x / n) * (1 + {K.RIDGE_ALPHA} / n)) AS b FROM c WHERE n >= 100)
SELECT period, n AS n_train, y / n - b * x / n AS intercept, b AS slope FROM f""")
def _(fx):
    clocked = R.scored(fx).withColumn("period", S.period(F.col("season"), F.col("week")))
    fits = M.ridge_by_cutoff(clocked, ["model_margin"], "margin", minimum=100)
    return fits.select("period", "n_train", "intercept", F.get("beta", F.lit(0)).alias("slope"))


@query("m3_winner_boost", floats="model_prob_home", ints="game_id")
def _(fx):
    return winner(fx).predict(next_season(fx)).select("game_id", "model_prob_home")


@query("m4_market_curve", floats="coefficient", views="games", sql=f"""
SELECT feature, coefficient FROM ({_newton(
    "SELECT spread_line AS x, CAST(margin > 0 AS INT) AS y FROM games "
    "WHERE completed AND season < 2001 AND margin <> 0 AND spread_line IS NOT NULL", f"max(1.0) / {K.MARKET_C}")}
SELECT 'intercept' AS feature, a AS coefficient FROM n WHERE i = 40
UNION ALL SELECT 'market_spread', b FROM n WHERE i = 40)""")
def _(fx):
    past = fx.games.where("season < 2001").withColumns(FT.market_columns())
    b0, b = M.market_curve(M.winner_training(past))
    return _coefficients(fx, [("intercept", b0), ("market_spread", b[0])])


@query("m5_log_odds_ensemble", floats="prob", ints="game_id", views="scored", sql=f"""
SELECT game_id, 1.0 / (1.0 + exp(-((0.40 * {logit('model_prob_home')} + 0.35 * {logit('elo_prob_home')}) / 0.75))) AS prob FROM scored""")
def _(fx):
    parts = {"logistic": F.col("model_prob_home"), "margin": F.col("elo_prob_home")}
    return R.scored(fx).select("game_id", M.ensemble_probability(parts).alias("prob"))


@query("m6_market_probability", floats="prob", ints="game_id", views="scored", sql=f"""
SELECT game_id, CASE WHEN game_id % 2 = 0 AND home_moneyline IS NOT NULL
       THEN {implied('home_moneyline')} / ({implied('home_moneyline')} + {implied('away_moneyline')})
       ELSE 1.0 / (1.0 + exp(-(0.15 * market_spread))) END AS prob FROM scored""")
def _(fx):
    # odd contests lose their two-way price, so the spread curve answers for them
    frame = R.scored(fx).withColumn("home_moneyline", F.when(F.col("game_id") % 2 == 0, F.col("home_moneyline")))
    return frame.select("game_id", M.market_probability(frame, S.expit(0.15 * F.col("market_spread"))).alias("prob"))


@query("m7_market_blend", floats="prob_home", ints="game_id", views="scored", sql="SELECT game_id, prob_home FROM scored")
def _(fx):
    return R.scored(fx).select("game_id", M.blend_probability(
        F.col("model_prob_home"), F.col("market_prob_home"), K.MARKET_BLEND).alias("prob_home"))


@query("m8_total_fit", floats="sigma train_mae intercept", ints="n_train")
def _(fx):
    t = total(fx)
    return fx.spark.createDataFrame(
        [(t.n_train, float(t.sigma), float(t.train_mae), t.ridge[0])],
        "n_train long, sigma double, train_mae double, intercept double")


_NEED = "(CASE WHEN market_total % 1.0 = 0 THEN market_total + 0.5 ELSE market_total END)"
TOTAL_FLOATS = "pred_total model_edge total_edge prob_over prob_over_model prob_push"


@query("m9_total_forecast", floats=TOTAL_FLOATS, ints="game_id", views="priced", sql=f"""
SELECT game_id, pred_total, model_edge, total_edge, ou_pick,
       CASE WHEN market_total IS NOT NULL THEN 1.0 - {phi(f'(({_NEED} - pred_total) / 13.3)')} END AS prob_over,
       CASE WHEN market_total IS NOT NULL THEN 1.0 - {phi(f'(({_NEED} - model_total) / 13.3)')} END AS prob_over_model,
       CASE WHEN market_total % 1.0 = 0 THEN {phi('((market_total + 0.5 - pred_total) / 13.3)')} - {phi('((market_total - 0.5 - pred_total) / 13.3)')} ELSE 0 END AS prob_push
FROM priced""")
def _(fx):
    return M.total_columns(R.scored(fx), F.lit(K.TOTAL_SIGMA)).select("game_id", "ou_pick", *TOTAL_FLOATS.split())


HALF_FLOATS = "total_slope total_intercept total_sigma margin_slope margin_intercept margin_sigma"


def _sigma(y: str, x: str) -> str:
    return f"sqrt(greatest(regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x}), 0) / count(*))"


@query("m10_half_calibration", floats=HALF_FLOATS, ints="n_train", views="scored", sql=f"""
SELECT n_train, n_train >= 200 AS fitted_from_history,
       CASE WHEN n_train >= 200 THEN ts ELSE 0.504 END AS total_slope, CASE WHEN n_train >= 200 THEN ti ELSE 0 END AS total_intercept,
       CASE WHEN n_train >= 200 THEN tg END AS total_sigma,
       CASE WHEN n_train >= 200 THEN ms ELSE 0.554 END AS margin_slope, CASE WHEN n_train >= 200 THEN mi ELSE 0 END AS margin_intercept,
       CASE WHEN n_train >= 200 THEN mg END AS margin_sigma
FROM (SELECT count(*) AS n_train, regr_slope(first_half_total, pred_total) AS ts, regr_intercept(first_half_total, pred_total) AS ti,
             {_sigma('first_half_total', 'pred_total')} AS tg, regr_slope(first_half_margin, pred_margin) AS ms,
             regr_intercept(first_half_margin, pred_margin) AS mi, {_sigma('first_half_margin', 'pred_margin')} AS mg
      FROM scored WHERE first_half_total IS NOT NULL)""")
def _(fx):
    return M.fit_halves(R.halved(fx))


SPLITS = ("home_team_total away_team_total first_half_total_pred first_half_margin_pred fh_home_total fh_away_total "
          "second_half_total_pred second_half_margin_pred")


@query("m11_half_forecast", floats=SPLITS, ints="game_id", views="halved", sql="""
SELECT game_id, home_team_total, away_team_total, first_half_total_pred, first_half_margin_pred,
       (first_half_total_pred + first_half_margin_pred) / 2.0 AS fh_home_total,
       (first_half_total_pred - first_half_margin_pred) / 2.0 AS fh_away_total,
       pred_total - first_half_total_pred AS second_half_total_pred,
       pred_margin - first_half_margin_pred AS second_half_margin_pred FROM halved""")
def _(fx):
    return M.predict_halves(R.halved(fx), M.fit_halves(R.halved(fx))).select("game_id", *SPLITS.split())


PROJECTIONS = [f"proj_{t}" for t in K.PLAYER_TARGETS]


@R.shared
def player_history(fx) -> tuple[DataFrame, DataFrame]:
    from ..plans.players import player_frames

    past, rows = player_frames(R.player_weeks(fx), fx.games, 2000, 20, R.injuries(fx))
    return materialize(past, "player-history"), materialize(rows, "player-slate")


@query("m12_player_fit", floats="intercept train_mae", ints="n_train")
def _(fx):
    past, _ = player_history(fx)
    model = M.fit_players(past)
    scored = model.raw(past)
    rows = None
    for t, (b0, _b) in model.ridge.items():
        one = M.involved(scored, t).agg(
            F.lit(t).alias("target"), F.count("*").alias("n_train"),
            F.avg(F.abs(F.col(t) - F.col(f"proj_{t}"))).alias("train_mae")).withColumn("intercept", F.lit(b0))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("m13_player_projection", floats=" ".join(["availability", *PROJECTIONS]), ints="player_id game_id")
def _(fx):
    past, rows = player_history(fx)
    return M.fit_players(past).predict(rows).select(
        "player_id", "game_id", "team", "availability", *PROJECTIONS)


REPLAY_FLOATS = "model_prob_home model_margin market_prob_home prob_home pred_margin model_total pred_total prob_over"


@query("m14_walk_forward", floats=REPLAY_FLOATS, ints="game_id season week n_train")
def _(fx):
    return replay(fx).select("game_id", "season", "week", "n_train", *REPLAY_FLOATS.split())


@query("m14_cutoffs", ints="period season history cutoff", views="games", sql="""
WITH p AS (SELECT season, season * 100 + week AS period, count(*) FILTER (WHERE completed) AS n FROM games GROUP BY ALL),
h AS (SELECT *, coalesce(sum(n) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS history FROM p),
e AS (SELECT * FROM h WHERE n > 0 AND season >= 1996 AND history >= 200)
SELECT period, season, history, min(period) OVER (PARTITION BY season) AS cutoff FROM e""")
def _(fx):
    return WF.cutoff_table(fx.games, 1996, refit="season", minimum=200)


@query("m14_weekly_linear", floats="model_margin margin_sigma model_total", ints="game_id n_train")
def _(fx):
    scored = WF.linear_walk_forward(R.model_inputs(fx), 1997, refit="week")
    return scored.select("game_id", "n_train", "model_margin", "margin_sigma", "model_total")


@query("m14_backtest_summary", floats="accuracy brier log_loss mean_prob", ints="n")
def _(fx):
    return WF.summarize(replay(fx)).summary


CARD = "pick_prob hit ats_win ou_win total_error"


@query("m15_track_season", floats=CARD, ints="game_id week n_train")
def _(fx):
    graded = WF.track_season(R.model_inputs(fx), 2001, OPTIONS)
    return graded.select("game_id", "week", "n_train", "pick", "ou_pick", *CARD.split())


SLATE = "prob_home pred_margin pred_total home_team_total first_half_total_pred ml_ev"


@query("m16_slate_forecast", floats=SLATE, ints="game_id season week")
def _(fx):
    row = R.target(fx)
    forecast = WF.predict_slate(R.features(fx), row["season"], row["week"], OPTIONS)
    return forecast.slate.select("game_id", "season", "week", "pick", "confidence", "ou_pick", *SLATE.split())


@query("m17_slate_players", floats=" ".join(["availability", *PROJECTIONS]), ints="player_id game_id")
def _(fx):
    row = R.target(fx)
    projected = WF.project_players(R.player_weeks(fx), fx.games, row["season"], row["week"], R.injuries(fx), None)
    if projected is None:  # too little history
        return fx.spark.createDataFrame([], "player_id long, game_id long, team string, availability double, "
                                        + ", ".join(f"{p} double" for p in PROJECTIONS))
    return projected.select("player_id", "game_id", "team", "availability", *PROJECTIONS)


@query("m18_evaluate_season", floats="accuracy brier log_loss mean_prob", ints="n")
def _(fx):
    rows = WF.evaluate_season(R.model_inputs(fx), 2000, OPTIONS)
    return G.probability_metrics(rows)
