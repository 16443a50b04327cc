"""Fits against closed forms, shared passes against single fits, no leakage in replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreslate import constants as K
from foreslate.catalog import frames as R
from foreslate.plans import models as M
from foreslate.plans import walkforward as WF


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) * [1.0, 10.0, 0.1] + [0.0, 5.0, 1.0]
    y = x @ [2.0, -0.3, 5.0] + rng.normal(size=600)
    rows = [(int(i // 60), *map(float, x[i]), 1.5, float(y[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "period int, a double, b double, c double, flat double, y double")
    return df.cache(), x, y


def ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - mean @ beta, beta


def test_ridge_matches_closed_form_and_ignores_a_constant(table):
    df, x, y = table
    row = M.ridge_fit(df, ["a", "b", "c", "flat"], "y").first()
    intercept, beta = ridge(x, y, 10.0)
    assert row["intercept"] == pytest.approx(intercept, abs=1e-6)
    assert row["beta"] == pytest.approx([*beta, 0.0], abs=1e-6)
    assert row["sigma"] == pytest.approx(np.std(y - intercept - x @ beta), abs=1e-6)


def test_ridge_at_cutoffs_matches_direct_fits(table):
    df, x, y = table
    fits = M.ridge_at(df, ["a", "b", "c"], "y", "period", [2, 5, 10])
    every = {r["period"]: r for r in M.ridge_by_cutoff(df, ["a", "b", "c"], "y").collect()}
    for cutoff, fit in fits.items():
        n = cutoff * 60
        intercept, beta = ridge(x[:n], y[:n], 10.0)
        assert fit.n_train == n
        assert fit.beta == pytest.approx(list(beta), abs=1e-6) and fit.intercept == pytest.approx(intercept, abs=1e-6)
        if cutoff in every:
            assert every[cutoff]["beta"] == pytest.approx(fit.beta, abs=1e-8)


def logistic(x, y, c, steps=50):
    """Newton in numpy: features in units of their population spread, penalty 1 / c on all but the intercept."""
    sd = np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / sd])
    b, penalty = np.zeros(z.shape[1]), np.array([0.0, *[1 / c] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * b)
    return b[0] - (b[1:] / sd) @ x.mean(0), b[1:] / sd


def test_logistic_fits_match_numpy(table):
    df, x, y = table
    won = F.col("y") > 2.0
    shared = M.logistic_at(df, ["a", "b", "c"], won, "period", [4, 10], 0.5)
    for cutoff, fit in shared.items():
        n = cutoff * 60
        intercept, beta = logistic(x[:n], (y[:n] > 2.0).astype(float), 0.5)
        assert fit.intercept == pytest.approx(intercept, abs=1e-6) and fit.beta == pytest.approx(list(beta), abs=1e-6)
        single = M.logistic_curve(df.where(F.col("period") < cutoff), ["a", "b", "c"], won, 0.5)
        assert single[0] == pytest.approx(intercept, abs=1e-6) and single[1] == pytest.approx(list(beta), abs=1e-6)


def test_separable_market_still_ends(table):
    df, _, _ = table
    fit = M.logistic_at(df, ["y"], F.col("y") > 0, "period", [10], K.MARKET_C, standardize=False)[10]
    assert np.isfinite(fit.intercept) and fit.beta[0] > 0


def test_half_calibration_falls_back_below_its_minimum(fx):
    few = R.scored(fx).where("game_id % 50 = 0")
    row = M.fit_halves(few).first()
    assert not row["fitted_from_history"]
    assert (row["total_slope"], row["margin_slope"]) == (K.HALF_TOTAL_SHARE, K.HALF_MARGIN_SLOPE)
    out = M.predict_halves(few, M.fit_halves(few)).first()
    assert out["home_team_total"] + out["away_team_total"] == pytest.approx(out["pred_total"])
    assert out["first_half_total_pred"] + out["second_half_total_pred"] == pytest.approx(out["pred_total"])


LINEAR = WF.ReplayOptions(boost=M.Boost(rounds=0), minimum=300)


def test_replay_ignores_what_came_later(fx):
    features = R.features(fx)
    late = F.col("season") >= 1999
    broken = features.withColumns({
        "margin": F.when(late, -F.col("margin") * 3 + 1).otherwise(F.col("margin")),
        "home_score": F.when(late, F.col("home_score") + 40).otherwise(F.col("home_score")),
    })

    def scores(frame):
        rows = WF.walk_forward(frame, 1997, 1998, "season", LINEAR)
        return {r["game_id"]: (r["prob_home"], r["pred_total"]) for r in rows.collect()}

    a, b = scores(features), scores(broken)
    assert a and a.keys() == b.keys()
    for g in a:
        assert a[g] == pytest.approx(b[g], abs=1e-9)


def test_stored_replay_is_reused_and_recomputed_from_rows(fx, tmp_path):
    first, hit = WF.stored_walk_forward(R.features(fx), str(tmp_path), 1999, 1999, options=LINEAR)
    second, again = WF.stored_walk_forward(R.features(fx), str(tmp_path), 1999, 1999, options=LINEAR)
    assert (hit, again) == (False, True)
    key = lambda r: r["method"]
    for x, y in zip(sorted(first.summary.collect(), key=key), sorted(second.summary.collect(), key=key)):
        assert x["n"] == y["n"] and x["accuracy"] == pytest.approx(y["accuracy"])


def test_boosted_replay_and_slate(fx):
    options = WF.ReplayOptions(boost=M.Boost(rounds=2), minimum=300)
    rows = WF.walk_forward(R.features(fx), 2000, 2000, "season", options).collect()
    assert rows and all(0 < r["model_prob_home"] < 1 for r in rows)
    with pytest.raises(ValueError):
        WF.guard_warmup(fx.games, 1995)
    with pytest.raises(ValueError):
        WF.predict_slate(R.features(fx), 1995, 2, options)


def test_tracking_cuts_at_the_first_kickoff(fx):
    graded = WF.track_season(R.features(fx), 1999, LINEAR)
    weeks = {(r["week"], r["n_train"]) for r in graded.select("week", "n_train").distinct().collect()}
    games = fx.games.where("completed AND margin <> 0")
    for week, n in list(weeks)[:3]:
        cut = fx.games.where((F.col("season") == 1999) & (F.col("week") == week)).agg(F.min("kickoff")).first()[0]
        assert n == games.where(F.col("kickoff") < F.lit(cut)).count()


def test_a_curve_of_rows_told_apart_settles_at_its_optimum(spark):
    """A quoted spread tells winners from losers; the penalty alone bounds the slope, and the loss is flat near it."""
    gaps = [g for g in range(-90, 91) if g] * 400
    x, y = np.array([(g * 6 // 10) / 2 for g in gaps]), np.array([g > 0 for g in gaps], float)
    rows = spark.createDataFrame(list(zip(map(float, gaps), x.tolist())), "margin double, market_spread double")
    b0, (b1,) = M.market_curve(rows)
    for _ in range(2):  # a Newton step from there goes nowhere
        p = 1.0 / (1.0 + np.exp(-np.clip(b0 + b1 * x, -500, 500)))
        w = p * (1 - p)
        g0, g1 = (p - y).sum(), ((p - y) * x).sum() + b1 / K.MARKET_C
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1 / K.MARKET_C]])
        assert np.abs(np.linalg.solve(h, [g0, g1])).max() < 1e-6


def test_linear_parts_of_the_winner_grow_no_tree(monkeypatch, spark):
    from foreslate.catalog import REGISTRY
    from compare import SMALL

    def refuse(*_):
        raise AssertionError("trees were grown")

    monkeypatch.setattr(M, "boosted", refuse)
    for key in ("m1_winner_logistic", "m4_market_curve"):
        assert REGISTRY[key].run(spark, SMALL).count() > 1


def test_a_slate_with_both_forests_is_scored_in_bounded_time(spark):
    """Both forecasts in one plan copied their formulas at each use: the plan did not end, whatever the rows."""
    import signal

    import pandas as pd

    rng, n = np.random.default_rng(12), 800
    names = dict.fromkeys((*K.WINNER_FEATURES, *K.PASSER_FEATURES, *K.TOTAL_FEATURES))
    home, away = rng.integers(10, 40, n).astype(float), rng.integers(10, 40, n).astype(float)
    away += home == away
    data = pd.DataFrame({
        "game_id": np.arange(n), "season": 1995 + np.arange(n) // 200, "week": 1 + np.arange(n) % 200 // 20, "home_team": "a", "away_team": "b",
        "kickoff": pd.Timestamp("1995-01-01") + pd.to_timedelta(np.arange(n), "h"), "completed": True, "home_score": home, "away_score": away,
        "margin": home - away, "home_win": (home > away).astype(float), "market_spread": rng.normal(size=n) * 5 + (home - away) / 3,
        "market_total": 50.0 + np.arange(n) % 7, "home_moneyline": -120.0, "away_moneyline": 110.0,
        "first_half_total": (home + away) / 2, "first_half_margin": (home - away) / 2, "elo_prob_home": 0.5,
        **{f: rng.normal(size=n) for f in names}})
    features = spark.createDataFrame(data)

    def late(*_):
        raise TimeoutError("the slate was not scored in time")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(200)
    try:
        told = WF.predict_slate(features, 1998, 10, WF.ReplayOptions(boost=M.Boost(rounds=2)))
        rows = {r["game_id"]: r for r in told.slate.collect()}
        points = told.points.count()
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert sorted(rows) == list(range(780, 800)) and points > 0
    assert told.winner.boost is not None and told.total.boost is not None
    slate = features.where("game_id >= 780")
    for r in told.total.predict(slate).select("game_id", "pred_total").collect():
        assert rows[r["game_id"]]["pred_total"] == pytest.approx(r["pred_total"], abs=1e-12)
    for r in told.winner.predict(slate).select("game_id", "prob_home", "pred_margin").collect():
        assert [rows[r["game_id"]][c] for c in ("prob_home", "pred_margin")] == pytest.approx([r["prob_home"], r["pred_margin"]], abs=1e-12)
