"""One leak-free feature row per contest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.scalars import clean_feature, clip
from ..operators.rating import RatingOptions, rating_pass
from ..operators.reshape import team_points_long
from ..operators.scans import center, decayed_scan, ewma
from ..sources.store import materialize_alone
from .passers import availability_features, passer_features

EDGES = {
    "epa_edge": ("epa_play", 1.0), "pass_epa_edge": ("pass_epa", 1.0),
    "rush_epa_edge": ("rush_epa", 1.0), "success_edge": ("success", 1.0),
    "explosive_edge": ("explosive", 1.0), "turnover_edge": ("turnover_rate", -1.0),
    "sack_edge": ("sack_rate", -1.0),
}


def team_observations(games: DataFrame, team_games: DataFrame | None) -> DataFrame:
    """Long schedule with every rolled statistic; absent ones are NULL."""
    long = team_points_long(games)
    wanted = [s for s in K.ROLLED_STATS if not s.startswith("points_")]
    have = [s for s in wanted if team_games is not None and s in team_games.columns]
    if have:
        long = long.join(team_games.select("game_id", "team", *have), ["game_id", "team"], "left")
    return long.withColumns({
        s: F.lit(None).cast("double") for s in wanted if s not in have
    })


def blended_form(now: np.ndarray, last: np.ndarray, games_seen: np.ndarray, carry=K.FORM_CARRY,
                 full=K.FORM_FULL_GAMES) -> np.ndarray:
    """In-season average sliding in over last season's shrunk final value; NaN where absent."""
    prior = last * carry
    weight = np.minimum(games_seen / full, 1.0) if full > 0 else np.ones_like(games_seen)
    mixed = weight * now + (1.0 - weight) * prior
    return np.where(np.isnan(now), prior, np.where(np.isnan(prior), now, mixed))


def team_form(games: DataFrame, team_games: DataFrame | None, stats=K.ROLLED_STATS,
              alpha: float = K.FORM_ALPHA) -> DataFrame:
    """Pregame form of every team in every contest, centred on earlier seasons.

    ``form_games`` counts earlier contests of the season in which the first
    statistic was observed.  The blend is worked out as arrays inside the scan, so its states are not written.
    """
    centered = center(team_observations(games, team_games), list(stats))

    def form(tables: dict[str, np.ndarray]) -> list[np.ndarray]:
        seen = tables["count"][:, :1]
        return [*blended_form(tables["state"], tables["entered"], seen).T, seen[:, 0]]

    rolled = decayed_scan(
        centered, entity=["team"], restart=["season"], order=["week", "kickoff", "game_id", "is_home"],
        values={s: ewma(alpha) for s in stats}, told=([*stats, "form_games"], form),
    )
    return rolled.select("game_id", "team", "is_home", *stats, "form_games")


def _paired_sides(form: DataFrame, columns) -> DataFrame:
    """One row per game with a struct per side, one shuffle.

    A hundred single columns would make code that the JVM does not compile.
    """
    home, side = F.col("is_home"), F.struct(*columns)
    return form.groupBy("game_id").agg(
        F.max(F.when(home, side)).alias("__home"), F.max(F.when(~home, side)).alias("__away"))


def _side_columns(columns) -> list[Column]:
    return [F.col(f"__{s}.{c}").alias(f"{s}_{c}") for s in ("home", "away") for c in columns]


def sides_to_game(form: DataFrame, columns) -> DataFrame:
    """Two team rows to one game row with home_ and away_ columns, one shuffle."""
    return _paired_sides(form, columns).select("game_id", *_side_columns(columns))


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def matchup_edges() -> dict[str, Column]:
    """Own offence plus what the other defence allows, home minus away."""
    return {
        name: sign * (
            (_known(f"home_off_{s}") + _known(f"away_def_{s}"))
            - (_known(f"away_off_{s}") + _known(f"home_def_{s}"))
        )
        for name, (s, sign) in EDGES.items()
    }


def situation() -> dict[str, Column]:
    rest = F.coalesce(F.col("home_rest") - F.col("away_rest"), F.lit(0)).cast("double")
    return {
        "rest_diff": clip(rest, -K.REST_CAP_DAYS, K.REST_CAP_DAYS),
        "div_game": F.coalesce(F.col("div_game").cast("double"), F.lit(0.0)),
        "neutral": F.col("neutral").cast("double"),
        "is_playoff": F.col("is_playoff").cast("double"),
        "form_confidence": F.least(
            F.coalesce(F.least("home_form_games", "away_form_games"), F.lit(0.0)),
            F.lit(K.FORM_CONFIDENCE_CAP),
        ),
    }


def pair_sums() -> dict[str, Column]:
    """Both sides added together; a total does not care who is better."""

    def pair(stat: str) -> Column:
        return _known(f"home_{stat}") + _known(f"away_{stat}")

    def both(stat: str) -> Column:
        return pair(f"off_{stat}") + pair(f"def_{stat}")

    return {
        "scoring_sum": (pair("points_for") + pair("points_against")) / 2.0,
        "off_epa_sum": pair("off_epa_play"), "def_epa_sum": pair("def_epa_play"),
        "explosive_sum": both("explosive"), "turnover_sum": both("turnover_rate"),
        "plays_sum": both("plays"), "drives_sum": both("drives"),
        "plays_per_drive_sum": both("plays_per_drive"), "pass_rate_sum": both("pass_rate"),
    }


def weather() -> dict[str, Column]:
    """Indoors is calm and mild; an absent outdoor reading is a mild day."""
    indoor = F.coalesce(F.col("roof").isin(*K.INDOOR_ROOFS), F.lit(False))

    def reading(name: str, default: float, bounds) -> Column:
        value = F.when(~indoor, F.col(name).try_cast("double"))
        return clip(F.coalesce(value, F.lit(default)), *bounds)

    return {
        "is_indoor": indoor.cast("double"),
        "wind_speed": reading("wind", 0.0, K.WIND_BOUNDS),
        "temperature": reading("temp", K.INDOOR_TEMPERATURE, K.TEMPERATURE_BOUNDS),
    }


def market_columns() -> dict[str, Column]:
    return {
        "market_spread": F.col("spread_line").cast("double"),
        "has_market": F.col("spread_line").isNotNull().cast("double"),
        "market_total": F.col("total_line").cast("double"),
        "has_market_total": F.col("total_line").isNotNull().cast("double"),
    }


def attach_halves(games: DataFrame, halves: DataFrame | None) -> DataFrame:
    """Half-time outcome, one row per key; targets only, never features."""
    if halves is None:
        none = F.lit(None).cast("double")
        out = games.withColumns({"home_first_half": none, "away_first_half": none})
    else:
        one = halves.groupBy("game_id").agg(
            F.max("home_first_half").alias("home_first_half"),
            F.max("away_first_half").alias("away_first_half"),
        )
        out = games.join(one, "game_id", "left")
    home, away = F.col("home_first_half"), F.col("away_first_half")
    return out.withColumns({"first_half_total": home + away, "first_half_margin": home - away})


def build_features(
    games: DataFrame,
    team_games: DataFrame | None = None,
    player_weeks: DataFrame | None = None,
    injuries: DataFrame | None = None,
    halves: DataFrame | None = None,
    rating: RatingOptions = RatingOptions(),
    min_dropbacks: float = K.PASSER_MIN_DROPBACKS,
    sides: bool = True,
) -> DataFrame:
    """Rating, form, situation, scoring, passer, availability and market columns, and each side's own form where ``sides``.

    Every part is written as the columns it adds; the wide tables it came from are deleted before the next one.
    """
    spark = games.sparkSession
    pregame, _ = rating_pass(games, team_games, rating)
    # what is read off the sides is worked out beside them; they cross the joins as one column each
    sums = {**matchup_edges(), **pair_sums()}

    def paired() -> DataFrame:
        form = _paired_sides(team_form(games, team_games), [*K.ROLLED_STATS, "form_games"])
        return form.select("*", *_side_columns([*K.ROLLED_STATS, "form_games"])).withColumns(sums).select(
            "game_id", *["__home", "__away"] * sides, "home_form_games", "away_form_games", *sums)

    form = materialize_alone(spark, "form-terms", paired)
    out = games.join(pregame, "game_id", "left").join(form, "game_id", "left").fillna(0.0, list(sums))
    out = out.withColumns({**situation(), **weather(), **market_columns()})
    zero = F.lit(0.0)
    if player_weeks is None:
        out = out.withColumns({"qb_delta": zero, "qb_edge": zero})
    else:
        passers = materialize_alone(spark, "passer-terms", lambda: passer_features(games, player_weeks, min_dropbacks))
        out = out.join(passers, "game_id", "left")
    if player_weeks is None or injuries is None:
        out = out.withColumn("availability_edge", zero)
    else:
        absences = materialize_alone(spark, "availability-terms", lambda: availability_features(games, player_weeks, injuries))
        out = out.join(absences, "game_id", "left")
    out = attach_halves(out, halves)
    model_inputs = dict.fromkeys((*K.WINNER_FEATURES, *K.TOTAL_FEATURES, *K.PASSER_FEATURES))
    cleaned = out.withColumns({c: clean_feature(F.col(c)) for c in model_inputs})
    return cleaned.select(*[c for c in cleaned.columns if c not in ("__home", "__away")],
                          *(_side_columns(K.ROLLED_STATS) if sides else ()))
