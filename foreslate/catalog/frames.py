"""DataFrames several queries start from, built once per fixture."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import grading as G
from ..operators import reshape as U
from ..plans import features as FT
from ..plans import models as M
from ..plans import passers as P
from ..sources.fixtures import Fixture
from ..sources.store import materialize, materialize_alone
from ..sources.readers import derive_player_columns, derive_report_columns


def shared(build):
    """Build once per fixture object."""

    @wraps(build)
    def cached(fx: Fixture):
        store = fx.__dict__.setdefault("_shared", {})
        if build.__name__ not in store:
            store[build.__name__] = build(fx)
        return store[build.__name__]

    return cached


def kept(df: DataFrame) -> DataFrame:
    return materialize(df, "frame")


@shared
def flagged_plays(fx: Fixture) -> DataFrame:
    """Plays with the pass and rush flags the fixture folds into play_type."""
    return fx.plays.withColumns({
        "pass": (F.col("play_type") == "pass").cast("double"),
        "rush": (F.col("play_type") == "run").cast("double"),
    })


@shared
def team_games(fx: Fixture) -> DataFrame:
    return kept(A.team_games(flagged_plays(fx), min_plays=1))


@shared
def scored_plays(fx: Fixture) -> DataFrame:
    teams = fx.games.select("game_id", "home_team", "away_team")
    return A.running_scores(fx.plays.join(teams, "game_id"))


@shared
def halves(fx: Fixture) -> DataFrame:
    return kept(A.half_scores(scored_plays(fx)))


@shared
def player_weeks(fx: Fixture) -> DataFrame:
    return derive_player_columns(fx.player_weeks)


@shared
def injuries(fx: Fixture) -> DataFrame:
    return derive_report_columns(fx.injuries)


@shared
def scored(fx: Fixture) -> DataFrame:
    """Stand-in forecasts from exact arithmetic on the contests: a projection, so a query reads the columns it needs."""
    gid = F.col("game_id")
    noise = ((gid * 37) % 101 - 50) / 10.0
    base = fx.games.withColumns({
        "market_spread": F.col("spread_line"),
        "market_total": F.col("total_line"),
        "actual_total": F.col("home_score") + F.col("away_score"),
        "noise": noise,
        "model_margin": F.coalesce("spread_line", F.lit(0.0)) * 0.8 + noise,
        "model_total": F.coalesce("total_line", F.lit(100.0)) * 0.85 + 15.0 + ((gid * 53) % 41 - 20) / 4.0,
    })
    margin, spread = F.col("model_margin"), F.col("market_spread")
    total, line = F.col("model_total"), F.col("market_total")
    base = base.withColumns({
        "model_prob_home": S.expit(margin / 7.0),
        "elo_prob_home": S.expit(F.col("noise") / 4.0),
        "market_prob_home": S.devig_moneyline(F.col("home_moneyline"), F.col("away_moneyline")),
        "pred_margin": F.when(spread.isNull(), margin).otherwise(0.1 * margin + 0.9 * spread),
        "pred_total": F.when(line.isNull(), total).otherwise(0.1 * total + 0.9 * line),
    })
    return base.withColumn("prob_home", M.blend_probability(
        F.col("model_prob_home"), F.col("market_prob_home"), 0.1))


@shared
def halved(fx: Fixture) -> DataFrame:
    """The stand-in forecasts beside the half-time outcome."""
    return kept(FT.attach_halves(scored(fx), halves(fx)))


@shared
def settled(fx: Fixture) -> DataFrame:
    return scored(fx).where("completed")


@shared
def graded(fx: Fixture) -> DataFrame:
    return G.grade(settled(fx))


@shared
def priced(fx: Fixture) -> DataFrame:
    """Picks and edges on the stand-in forecasts, with the total columns."""
    return M.total_columns(G.attach_edges(scored(fx)), F.lit(13.3))


@shared
def observed(fx: Fixture) -> DataFrame:
    """Long schedule with every rolled statistic."""
    return FT.team_observations(fx.games, team_games(fx))


@shared
def form(fx: Fixture) -> DataFrame:
    return kept(FT.team_form(fx.games, team_games(fx)))


@shared
def elo(fx: Fixture) -> DataFrame:
    """A rating with an exact SQL form, standing in for the sequential one."""
    edge = F.avg(F.col("points_for") - F.col("points_against"))
    return U.team_points_long(fx.games.where("completed")).groupBy("team").agg(
        (F.lit(1500) + 10 * edge).alias("elo"), (10 * edge / 25.0).alias("spread_vs_average"))


@shared
def features(fx: Fixture) -> DataFrame:
    """The full feature table of the fixture."""
    inputs = fx.games, team_games(fx), player_weeks(fx), injuries(fx), halves(fx)
    return materialize_alone(fx.spark, "frame", lambda: FT.build_features(*inputs, min_dropbacks=1))


@shared
def model_inputs(fx: Fixture) -> DataFrame:
    """What fits and their replays read of the feature table, without halves and single sides; the full table where it is kept already."""
    if "features" in fx.__dict__.get("_shared", {}):
        return features(fx)
    tables = fx.games, team_games(fx), player_weeks(fx), injuries(fx)
    inputs = dict.fromkeys([*K.WINNER_FEATURES, *K.TOTAL_FEATURES, *K.PASSER_FEATURES])
    return materialize_alone(fx.spark, "frame", lambda: FT.build_features(*tables, min_dropbacks=1, sides=False).select(
        "game_id", "season", "week", "kickoff", "completed", "home_team", "away_team", "home_score", "away_score", "margin", "home_win",
        "home_moneyline", "away_moneyline", "market_spread", "market_total", "elo_prob_home", *inputs))


@shared
def raw_log(fx: Fixture) -> DataFrame:
    """The contests as a landed text log, with unreadable days, times and rests."""
    gid = F.col("game_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return fx.games.select(
        gid.cast("string").alias("game_id"), "season", "week",
        F.when(F.col("is_playoff"), "POST").otherwise("REG").alias("game_type"),
        F.when(gid % 50 != 7, F.date_format("kickoff", "yyyy-MM-dd")).otherwise("unknown").alias("gameday"),
        F.when(gid % 6 != 0, F.concat(two(gid % 24), F.lit(":"), two(gid * 7 % 60))).alias("gametime"),
        "home_team", "away_team", "home_score", "away_score", F.col("margin").alias("result"),
        F.when(gid % 13 == 0, "bad").otherwise(F.col("home_rest").cast("string")).alias("home_rest"),
        "away_rest", "home_moneyline", "away_moneyline", "spread_line", "total_line",
        F.col("div_game").cast("int").alias("div_game"), "temp", "wind", "roof",
        F.when(F.col("neutral"), "Neutral").otherwise("Home").alias("location"),
        F.col("home_qb_id").cast("string").alias("home_qb_id"),
        F.col("away_qb_id").cast("string").alias("away_qb_id"),
    )


@shared
def paired(fx: Fixture) -> DataFrame:
    """Contests with both sides' form beside them."""
    sides = FT.sides_to_game(form(fx), [*K.ROLLED_STATS, "form_games"])
    return fx.games.join(sides, "game_id", "left")


def paired_on(fx: Fixture, stats: tuple[str, ...]) -> DataFrame:
    """``paired`` with the form of some statistics only, which builds no others; of the full table where it is kept already.

    ``form_games`` counts observations of the first rolled statistic, so that one is always among them.
    """
    if "form" in fx.__dict__.get("_shared", {}):
        return paired(fx)
    stats = list(dict.fromkeys([K.ROLLED_STATS[0], *stats]))
    seen = A.team_games(flagged_plays(fx), min_plays=1)
    seen = kept(seen.select("game_id", "team", *[s for s in stats if s in seen.columns]))
    sides = FT.sides_to_game(FT.team_form(fx.games, seen, stats), [*stats, "form_games"])
    return fx.games.join(sides, "game_id", "left")


@shared
def absence(fx: Fixture) -> DataFrame:
    return kept(P.absence_cost(P.player_usage(player_weeks(fx)), injuries(fx)))


@shared
def with_team_totals(fx: Fixture) -> DataFrame:
    home, away = S.team_totals(F.col("pred_total"), F.col("pred_margin"))
    return scored(fx).withColumns({"home_team_total": home, "away_team_total": away})


@shared
def team_data(fx: Fixture) -> DataFrame:
    """Trailing scoring and the stand-in rating of every team, with its league."""
    table = U.trailing_team_table(fx.games).join(elo(fx), "team", "left")
    return table.withColumn("league", F.split("team", "/")[0])


@shared
def target(fx: Fixture):
    """Season and week of the slate to predict (one row)."""
    return U.target_slate(fx.games).first()
