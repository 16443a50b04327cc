"""Tie, push and boundary rules; slate selection; stores."""

import pytest
from pyspark.sql import functions as F

from foreslate.functions import scalars as S
from foreslate.operators import grading as G
from foreslate.operators import reshape as U
from foreslate.plans import features as FT
from foreslate.catalog import frames as R
from foreslate.sources import store as ST


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalar_identities(spark):
    r = one(
        spark,
        half=S.elo_to_prob(F.lit(0.0)), there=S.prob_to_spread(S.spread_to_prob(F.lit(3.5))),
        tie=S.mov_multiplier(F.lit(0.0), F.lit(100.0)), none=S.devig_moneyline(F.lit(None).cast("double"), F.lit(-110.0)),
        even=S.prob_to_american(F.lit(0.5)), floor=S.kelly_fraction(F.lit(0.1), F.lit(-110.0)),
        missing=S.confidence_tier(F.lit(None).cast("double")), word=S.injury_availability(F.lit(" Questionable ")),
        unlisted=S.injury_availability(F.lit(None).cast("string")),
        cap=S.edge_probability(F.lit(50.0), (0.0, 1.0)), pickem=S.spread_ticket(F.lit(1.0), F.lit(13.5), F.lit("H"), F.lit("A")),
        push=S.push_probability(F.lit(44.0), F.lit(44.5)), whole=S.push_probability(F.lit(44.0), F.lit(44.0)),
    )
    assert r["half"] == 0.5 and r["there"] == pytest.approx(3.5, abs=1e-4) and r["tie"] == 1.0
    assert r["none"] is None and r["even"] == -100.0 and r["floor"] == 0.0
    assert r["missing"] == "UNKNOWN" and r["word"] == 0.69 and r["unlisted"] == 1.0
    assert r["cap"] == 0.5238 and r["pickem"] == "H -13.5" and r["push"] == 0.0 and r["whole"] > 0.02


def graded(spark, rows):
    return spark.createDataFrame(rows, "prob_home double, home_win double, market_spread double, margin double, "
                                 "pred_margin double, actual_total double, market_total double, model_total double, "
                                 "pred_total double, home_team string, away_team string")


def test_pushes_ties_and_exact_half(spark):
    df = graded(spark, [
        (0.5, 1.0, 3.0, 3.0, 5.0, 44.0, 44.0, 50.0, 45.0, "H", "A"),
        (0.7, 0.5, 3.0, 0.0, 3.0, 50.0, 44.0, 44.0, 45.0, "H", "A"),
        (0.2, 0.0, None, -7.0, 1.0, 30.0, None, 40.0, 45.0, "H", "A"),
    ])
    a, b, c = G.grade(df).collect()
    # a probability of exactly one half picks home but scores as the away side
    assert (a["pick"], a["hit"], a["ats_win"], a["ou_win"]) == ("H", 0.0, None, None)
    # a zero edge is the away and the under side
    assert (b["hit"], b["ats_win"], b["ou_win"], b["ou_pick"]) == (0.5, 1.0, 0.0, "UNDER")
    assert (c["pick"], c["hit"], c["ats_win"], c["ou_pick"]) == ("A", 1.0, None, "-")
    record = {r["threshold"]: r for r in G.spread_record(df).collect()}
    assert (record[0.0]["bets"], record[0.0]["wins"], record[0.0]["pushes"]) == (2, 1, 1)
    table = G.calibration_table(df).collect()
    assert sum(r["games"] for r in table) == 3


def slates(spark, played):
    rows = [(f"{w}-{i}", 2020, w, f"2020-09-{w * 7 + i:02d}", done)
            for w, flags in played.items() for i, done in enumerate(flags)]
    df = spark.createDataFrame(rows, "game_id string, season int, week int, day string, completed boolean")
    return df.withColumn("kickoff", F.col("day").cast("timestamp_ntz"))


@pytest.mark.parametrize("played, want", [
    ({1: [1, 1, 1, 0], 2: [0, 0, 0, 0]}, 2),
    ({1: [1, 0, 0, 0], 2: [0, 0, 0, 0]}, 1),
    ({1: [1, 1], 2: [1, 0]}, 2),
    ({1: [1, 1], 2: [1, 1]}, 2),
    ({1: [1, 0], 2: [1, 1], 3: [0, 0]}, 3),
])
def test_target_slate(spark, played, want):
    games = slates(spark, {w: [bool(f) for f in flags] for w, flags in played.items()})
    assert tuple(U.target_slate(games).first()) == (2020, want)
    assert tuple(U.target_slate(games, week=1).first()) == (2020, 1)
    with pytest.raises(ValueError):
        U.target_slate(games, season=1990)


def test_training_history_is_strict(spark):
    games = slates(spark, {1: [True, True], 2: [True, False]})
    assert U.training_history(games, 2020, 2).count() == 2
    assert U.training_history(games, 2021, 1).count() == 3


def test_market_numbers_are_never_features(fx):
    from foreslate import constants as K

    used = set(K.WINNER_FEATURES + K.PASSER_FEATURES + K.TOTAL_FEATURES + K.PLAYER_FEATURES)
    assert not used & (set(K.MARKET_COLUMNS) | {"spread_line", "total_line", "home_moneyline", "away_moneyline"})


def test_features_exist_for_unplayed_games_and_ignore_later_results(fx):
    rows = R.features(fx)
    assert rows.count() == fx.games.count()
    late = F.col("season") >= 1999
    hidden = fx.games.withColumns({c: F.when(~late, F.col(c)) for c in ("home_score", "away_score", "margin", "home_win")})
    hidden = hidden.withColumn("completed", F.col("completed") & ~late)
    early = R.team_games(fx).where("season < 1999")
    again = FT.team_form(hidden, early).where("off_epa_play IS NOT NULL OR points_for IS NOT NULL")
    full = R.form(fx)
    past = fx.games.where("season <= 1998").select("game_id")
    both = full.join(past, "game_id", "left_semi").alias("a").join(again.alias("b"), ["game_id", "team"])
    gap = both.select(F.max(F.abs(F.col("a.off_epa_play") - F.col("b.off_epa_play"))),
                      F.max(F.abs(F.col("a.points_for") - F.col("b.points_for")))).first()
    assert gap[0] < 1e-9 and gap[1] < 1e-9


def test_store_builds_only_what_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(2000, 1), (2001, 2)], "season int, v int")
    path, asked = str(tmp_path / "t"), []

    def build(missing):
        asked.append(missing)
        return df.where(F.col("season").isin(missing))

    assert ST.build_missing_seasons(spark, path, [2000], build) == [2000]
    assert ST.build_missing_seasons(spark, path, [2000, 2001], build) == [2001]
    assert ST.build_missing_seasons(spark, path, [2000, 2001], build) == []
    assert asked == [[2000], [2001]] and ST.read_seasons(spark, path).count() == 2


def test_empty_inputs_give_zero_terms(fx):
    none = FT.build_features(fx.games).select("qb_delta", "qb_edge", "availability_edge").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0.0, 0.0)]


def test_run_key_changes_with_every_option_and_score(fx):
    from foreslate.plans import models as M
    from foreslate.plans.walkforward import ReplayOptions
    from foreslate.sources.store import run_fingerprint

    key = lambda games, **kw: run_fingerprint(games, **kw).first()["run_id"]
    plain = key(fx.games, settings=repr(ReplayOptions()))
    assert plain == key(fx.games, settings=repr(ReplayOptions()))
    assert plain != key(fx.games, settings=repr(ReplayOptions(boost=M.Boost(rounds=0))))
    assert plain != key(fx.games, settings=repr(ReplayOptions(minimum=1)))
    one = fx.games.where("completed").agg(F.min("game_id")).first()[0]
    corrected = fx.games.withColumn("margin", F.when(F.col("game_id") == one, F.col("margin") + 1).otherwise(F.col("margin")))
    assert plain != key(corrected, settings=repr(ReplayOptions()))


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from foreslate.sources import store

    monkeypatch.setattr(store, "run_folder", lambda _: f"file://{tmp_path}/run")
    kept = store.materialize(spark.range(3), "kept")
    assert kept.count() == 3 and store.clear_scratch(spark)
    assert not store.clear_scratch(spark)
