"""The rating pass against a plain loop, and its identities."""

import math

import pytest
from pyspark.sql import functions as F

from foreslate import constants as K
from foreslate.operators import rating as RT


def expected(games, hfa):
    ratings, last, out = {}, {}, {}
    for g in games:
        lg = g["league"]
        if lg in last and last[lg] != g["season"]:
            for key in [k for k in ratings if k[0] == lg]:
                for _ in range(g["season"] - last[lg]):
                    ratings[key] = 1500 + 0.75 * (ratings[key] - 1500)
        last[lg] = g["season"]
        h, a = ratings.get((lg, g["home_team"]), 1500.0), ratings.get((lg, g["away_team"]), 1500.0)
        rest = 0.0
        if g["home_rest"] is not None and g["away_rest"] is not None:
            rest = max(-10, min(10, g["home_rest"] - g["away_rest"])) * 0.1
        diff = h - a + ((0.0 if g["neutral"] else hfa[(lg, g["season"])]) + rest) * 25
        out[g["game_id"]] = (h, a, diff)
        if not g["completed"]:
            continue
        p, m = 1 / (1 + 10 ** (-diff / 400)), g["margin"]
        mult = 1.0 if m == 0 else math.log(abs(m) + 1) * 2.2 / ((diff if m > 0 else -diff) * 0.001 + 2.2)
        shift = 20 * mult * ((1.0 if m > 0 else 0.0 if m < 0 else 0.5) - p)
        ratings[(lg, g["home_team"])] = h + shift
        ratings[(lg, g["away_team"])] = a - shift
    return out, ratings


@pytest.fixture(scope="module")
def reference(fx):
    hfa = {(r["league"], r["season"]): r["hfa"] for r in RT.home_advantage(fx.games).collect()}
    games = [r.asDict() for r in fx.games.orderBy("season", "week", "kickoff", "game_id").collect()]
    return expected(games, hfa)


@pytest.mark.parametrize("batch", ["10000", "37"])
def test_pass_matches_loop_whatever_the_batches(spark, fx, reference, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        pregame, state = RT.rating_pass(fx.games)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, final = reference
    rows = pregame.collect()
    assert len(rows) == len(want)
    for r in rows:
        for a, b in zip((r["elo_home_pre"], r["elo_away_pre"], r["elo_diff"]), want[r["game_id"]]):
            assert a == pytest.approx(b, abs=1e-8)
    got = {(r["league"], r["team"]): r["elo"] for r in RT.current_ratings(state).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in final.items()}


def test_rows_without_week_or_season_stay(fx):
    week = F.when(F.col("game_id") % 31 != 0, F.col("week"))
    season = F.when(F.col("game_id") % 97 != 0, F.col("season"))
    pregame, _ = RT.rating_pass(fx.games.withColumns({"week": week, "season": season}))
    assert pregame.count() == fx.games.count()


def test_updates_are_zero_sum_and_unplayed_games_teach_nothing(fx):
    _, state = RT.rating_pass(fx.games)
    means = RT.current_ratings(state).groupBy("league").agg(F.avg("elo").alias("m")).collect()
    assert all(r["m"] == pytest.approx(1500, abs=1e-6) for r in means)
    _, again = RT.rating_pass(fx.games.where("completed"))
    a = {r["name"]: r["value"] for r in state.collect()}
    b = {r["name"]: r["value"] for r in again.collect()}
    assert {k: a[k] for k in b} == {k: pytest.approx(v, abs=1e-8) for k, v in b.items()}


def test_erasing_later_results_keeps_earlier_ratings(fx):
    late = F.col("season") >= 1999
    hidden = fx.games.withColumns({
        "completed": F.col("completed") & ~late, "margin": F.when(~late, F.col("margin"))})
    a = {r["game_id"]: r["elo_diff"] for r in RT.rating_pass(fx.games.where("season < 2000"))[0].collect()}
    b = {r["game_id"]: r["elo_diff"] for r in RT.rating_pass(hidden.where("season < 2000"))[0].collect()}
    early = [r["game_id"] for r in fx.games.where("season <= 1998").select("game_id").collect()]
    assert all(a[g] == pytest.approx(b[g], abs=1e-9) for g in early)


def test_passer_term_is_capped_and_learns(spark):
    games = [("L", 2000, w, f"g{w:02d}", "A", "B", "p1" if w < 5 else "p9", "p2", True, 7.0) for w in range(1, 8)]
    df = spark.createDataFrame(games, "league string, season int, week int, game_id string, home_team string, "
                               "away_team string, home_qb_id string, away_qb_id string, completed boolean, margin double")
    df = df.withColumns({"kickoff": F.lit("2000-01-01").cast("timestamp_ntz"), "neutral": F.lit(False),
                         "is_playoff": F.lit(False), "home_rest": F.lit(7.0), "away_rest": F.lit(7.0)})
    seen = df.select("game_id", F.explode(F.array("home_team", "away_team")).alias("team")).withColumn(
        "off_epa_play", F.when(F.col("team") == "A", 0.4).otherwise(-0.4))
    out = RT.rating_pass(df, seen, RT.RatingOptions(use_passer=True))[0]
    terms = {r["game_id"]: r["elo_qb_points"] for r in out.collect()}
    assert terms["g01"] == 0.0
    # an unknown starter sits a fixed step below the usual level, the rival is known
    assert abs(terms["g05"]) <= 2 * K.RATING_PASSER_CAP and terms["g05"] < terms["g04"]
