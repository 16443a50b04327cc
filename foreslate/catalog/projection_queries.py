"""P-rows: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import reshape as U
from ..plans import features as FT
from ..plans import models as M
from ..plans import players as PL
from ..plans import walkforward as WF
from ..sources import readers as RD
from . import frames as R
from .registry import query
from .shared_sql import clip, ratio


@query("p1_numeric_coercion", floats="number", ints="game_id", views="games", sql="""
SELECT game_id, raw, CASE WHEN NOT isnan(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS number
FROM (SELECT game_id, CASE game_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN CAST(CAST(home_score AS BIGINT) AS VARCHAR)
      WHEN 3 THEN CAST(game_id AS VARCHAR) || '.25' ELSE '' END AS raw FROM games)""")
def _(fx):
    kind = F.col("game_id") % 5
    raw = (F.when(kind == 0, "n/a").when(kind == 1, "NaN")
           .when(kind == 2, F.col("home_score").cast("long").cast("string"))
           .when(kind == 3, F.concat(F.col("game_id").cast("string"), F.lit(".25"))).otherwise(""))
    return fx.games.select("game_id", raw.alias("raw")).withColumn("number", S.as_number(F.col("raw")))


_CLOCK = "lpad(CAST(game_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(game_id * 7 % 60 AS VARCHAR), 2, '0')"


@query("p2_kickoff", ints="game_id", views="games", sql=f"""
SELECT game_id, strftime(day + CASE WHEN clock IS NULL THEN INTERVAL 0 MINUTE
         ELSE to_minutes(CAST(split_part(clock, ':', 1) AS BIGINT) * 60 + CAST(split_part(clock, ':', 2) AS BIGINT)) END,
       '%Y-%m-%d %H:%M') AS kickoff
FROM (SELECT game_id, CASE WHEN game_id % 50 <> 7 THEN CAST(CAST(kickoff AS DATE) AS TIMESTAMP) END AS day,
             CASE WHEN game_id % 6 <> 0 THEN {_CLOCK} END AS clock FROM games)""")
def _(fx):
    return RD.derive_game_columns(R.raw_log(fx)).select(
        F.col("game_id").cast("long"), F.date_format("kickoff", "yyyy-MM-dd HH:mm").alias("kickoff"))


@query("p3_outcomes", floats="margin home_win", ints="game_id", views="games",
       sql="SELECT game_id, completed, margin, home_win, neutral, is_playoff FROM games")
def _(fx):
    return RD.derive_game_columns(R.raw_log(fx)).select(
        F.col("game_id").cast("long"), "completed", "margin", "home_win", "neutral", "is_playoff")


_CODES = "['SD', 'STL', 'OAK', 'LAC', 'LA', 'LV', 'KC']"


@query("p4_code_normalisation", ints="game_id", views="games", sql=f"""
SELECT game_id, code, CASE code WHEN 'SD' THEN 'LAC' WHEN 'STL' THEN 'LA' WHEN 'OAK' THEN 'LV' ELSE code END AS team
FROM (SELECT game_id, {_CODES}[CAST(game_id % 8 AS INT) + 1] AS code FROM games)""")
def _(fx):
    codes = F.array(*[F.lit(c) for c in ("SD", "STL", "OAK", "LAC", "LA", "LV", "KC")])
    code = F.get(codes, (F.col("game_id") % 8).cast("int"))
    return fx.games.select("game_id", code.alias("code")).withColumn("team", S.normalize_team(F.col("code")))


@query("p5_scrimmage_plays", floats="epa", ints="game_id seq", views="scrimmage",
       sql="SELECT game_id, seq, posteam, defteam, epa FROM scrimmage")
def _(fx):
    return A.scrimmage_plays(fx.plays).select("game_id", "seq", "posteam", "defteam", "epa")


@query("p6_flag_coercion", floats="interception fumble_lost sack", ints="game_id seq", views="plays", sql="""
SELECT game_id, seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE interception END AS interception, 0 AS fumble_lost,
       CASE WHEN seq % 2 = 0 THEN 0 ELSE sack END AS sack FROM plays""")
def _(fx):
    odd = fx.plays.withColumns({
        "interception": F.when(F.col("seq") % 3 != 0, F.col("interception")),
        "sack": F.when(F.col("seq") % 2 == 0, "?").otherwise(F.col("sack").cast("string")),
    })
    return A.coerce_flags(odd).select("game_id", "seq", "interception", "fumble_lost", "sack")


@query("p7_play_outcomes", floats="explosive turnover", ints="game_id seq", views="plays", sql="""
SELECT game_id, seq, CASE WHEN yards_gained >= 20 THEN 1 ELSE 0 END AS explosive,
       least(least(greatest(interception, 0), 1) + least(greatest(sack, 0), 1), 1) AS turnover FROM plays""")
def _(fx):
    # the fixture has no fumbles; its sacks stand in so both terms are live
    plays = fx.plays.withColumn("fumble_lost", F.col("sack"))
    return A.play_outcomes(plays).select("game_id", "seq", "explosive", "turnover")


@query("p8_dropbacks", floats="dropbacks passing_epa_per_dropback", ints="player_id game_id", views="player_weeks", sql="""
SELECT player_id, game_id, team, attempts + sacks_suffered AS dropbacks,
       passing_epa / nullif(attempts + sacks_suffered, 0) AS passing_epa_per_dropback FROM player_weeks""")
def _(fx):
    return R.player_weeks(fx).select("player_id", "game_id", "team", "dropbacks", "passing_epa_per_dropback")


@query("p9_listed_availability", floats="availability", ints="season week gsis_id", views="report",
       sql="SELECT season, week, team, gsis_id, trim(report_status) AS report_status, availability FROM report")
def _(fx):
    return R.injuries(fx).select("season", "week", "team", "gsis_id", "report_status", "availability")


@query("p10_winner_training", floats="margin", ints="game_id", views="games",
       sql="SELECT game_id, margin FROM games WHERE completed AND margin <> 0")
def _(fx):
    return M.winner_training(fx.games).select("game_id", "margin")


@query("p11_involvement", ints="season rows", views="player_weeks", sql="UNION ALL ".join(
    f"SELECT '{t}' AS target, season, count(*) AS rows FROM player_weeks WHERE {t} > 0 OR {v} > 0 GROUP BY season "
    for t, v in K.PLAYER_TARGETS.items()))
def _(fx):
    frames = [M.involved(R.player_weeks(fx), t).groupBy("season").agg(F.count("*").alias("rows"))
              .withColumn("target", F.lit(t)) for t in K.PLAYER_TARGETS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("p12_clean_features", floats="clean", ints="game_id", views="games", sql="""
SELECT game_id, CASE game_id % 4 WHEN 3 THEN coalesce(margin, 0) ELSE 0 END AS clean FROM games""")
def _(fx):
    kind = F.col("game_id") % 4
    dirty = (F.when(kind == 0, float("nan")).when(kind == 1, float("inf"))
             .when(kind == 2, float("-inf")).otherwise(F.col("margin")))
    return fx.games.select("game_id", S.clean_feature(dirty).alias("clean"))


def _edge_sql(stat: str, sign: float) -> str:
    return (f"{sign} * ((coalesce(home_off_{stat}, 0) + coalesce(away_def_{stat}, 0)) "
            f"- (coalesce(away_off_{stat}, 0) + coalesce(home_def_{stat}, 0)))")


@query("p13_matchup_edges", floats=" ".join(FT.EDGES), ints="game_id", views="paired",
       sql=f"SELECT game_id, {', '.join(f'{_edge_sql(*e)} AS {n}' for n, e in FT.EDGES.items())} FROM paired")
def _(fx):
    return R.paired(fx).withColumns(FT.matchup_edges()).select("game_id", *FT.EDGES)


SITUATION = ["rest_diff", "div_game", "neutral", "is_playoff", "form_confidence"]


@query("p14_situation", floats=" ".join(SITUATION), ints="game_id", views="paired", sql=f"""
SELECT game_id, {clip('coalesce(home_rest - away_rest, 0)', -10, 10)} AS rest_diff, CAST(div_game AS INT) AS div_game,
       CAST(neutral AS INT) AS neutral, CAST(is_playoff AS INT) AS is_playoff,
       least(coalesce(least(home_form_games, away_form_games), 0), 8) AS form_confidence FROM paired""")
def _(fx):
    return R.paired(fx).withColumns(FT.situation()).select("game_id", *SITUATION)


def _pair(s: str) -> str:
    return f"(coalesce(home_{s}, 0) + coalesce(away_{s}, 0))"


PAIR_SQL = {
    "scoring_sum": f"({_pair('points_for')} + {_pair('points_against')}) / 2.0",
    "off_epa_sum": _pair("off_epa_play"), "def_epa_sum": _pair("def_epa_play"),
    **{f"{n}_sum": f"{_pair('off_' + s)} + {_pair('def_' + s)}" for n, s in (
        ("explosive", "explosive"), ("turnover", "turnover_rate"), ("plays", "plays"), ("drives", "drives"),
        ("plays_per_drive", "plays_per_drive"), ("pass_rate", "pass_rate"))},
}


@query("p15_pair_sums", floats=" ".join(PAIR_SQL), ints="game_id", views="paired",
       sql=f"SELECT game_id, {', '.join(f'{e} AS {n}' for n, e in PAIR_SQL.items())} FROM paired")
def _(fx):
    return R.paired(fx).withColumns(FT.pair_sums()).select("game_id", *PAIR_SQL)


@query("p16_weather", floats="is_indoor wind_speed temperature", ints="game_id", views="games", sql="""
SELECT game_id, CAST(roof IN ('dome', 'closed') AS INT) AS is_indoor,
       least(greatest(coalesce(CASE WHEN roof NOT IN ('dome', 'closed') THEN wind END, 0), 0), 35) AS wind_speed,
       least(greatest(coalesce(CASE WHEN roof NOT IN ('dome', 'closed') THEN temp END, 70), -10), 110) AS temperature FROM games""")
def _(fx):
    return fx.games.withColumns(FT.weather()).select("game_id", "is_indoor", "wind_speed", "temperature")


@query("p17_market_columns", floats=" ".join(K.MARKET_COLUMNS), ints="game_id", views="games", sql="""
SELECT game_id, spread_line AS market_spread, CAST(spread_line IS NOT NULL AS INT) AS has_market,
       total_line AS market_total, CAST(total_line IS NOT NULL AS INT) AS has_market_total FROM games""")
def _(fx):
    return fx.games.withColumns(FT.market_columns()).select("game_id", *K.MARKET_COLUMNS)


@query("p18_first_half", floats="first_half_total first_half_margin", ints="game_id", views="scored",
       sql="SELECT game_id, first_half_total, first_half_margin FROM scored")
def _(fx):
    return FT.attach_halves(fx.games, R.halves(fx)).select("game_id", "first_half_total", "first_half_margin")


@query("p19_attach_predictions", floats="market_spread pred_margin", ints="game_id", views="scored",
       sql="SELECT game_id, home_team, coalesce(market_spread, 0) AS market_spread, pred_margin FROM scored WHERE completed "
           "UNION ALL SELECT game_id, home_team, NULL, NULL FROM scored WHERE NOT completed")
def _(fx):
    predictions = R.settled(fx).select(
        "game_id", F.coalesce("market_spread", F.lit(0.0)).alias("market_spread"), "pred_margin")
    frame = fx.games.withColumns(FT.market_columns())
    return U.attach_by_key(frame, predictions).select("game_id", "home_team", "market_spread", "pred_margin")


@query("p20_guarded_ratio", floats="rate", ints="player_id game_id", views="player_weeks",
       sql=f"SELECT player_id, game_id, team, {ratio('rushing_yards', 'carries', (-5.0, 15.0))} AS rate FROM player_weeks")
def _(fx):
    rate = S.safe_ratio(F.col("rushing_yards"), F.col("carries"), K.RATE_BOUNDS["form_rush_ypc"])
    return R.player_weeks(fx).select("player_id", "game_id", "team", rate.alias("rate"))


@query("p21_projection_floor", floats="projection", ints="player_id game_id", views="player_weeks", sql="""
SELECT player_id, game_id, team, greatest(receiving_yards - 20, 0) * CASE WHEN player_id % 4 = 0 THEN 0.69 ELSE 1.0 END AS projection
FROM player_weeks""")
def _(fx):
    chance = F.when(F.col("player_id") % 4 == 0, 0.69).otherwise(1.0)
    return R.player_weeks(fx).select(
        "player_id", "game_id", "team",
        M.floor_projection(F.col("receiving_yards") - 20, chance).alias("projection"))


@query("p22_training_history", ints="game_id", views="games", sql="""
SELECT game_id FROM games WHERE completed AND kickoff < (SELECT min(kickoff) FROM games WHERE season = 1999 AND week = 10)""")
def _(fx):
    return U.training_history(fx.games, 1999, 10).select("game_id")


@query("p23_warmup_guard", ints="first_season", views="games", sql="SELECT min(season) AS first_season FROM games")
def _(fx):
    first = fx.games.agg(F.min("season").alias("first_season"))
    WF.guard_warmup(fx.games, first.first()[0] + 1)
    return first


@query("p24_player_history_window", ints="player_id game_id", views="player_weeks", sql="""
SELECT player_id, game_id, team FROM player_weeks WHERE season * 100 + week < 200010 AND season >= 2000 - 10""")
def _(fx):
    return PL.history_window(R.player_weeks(fx), 2000, 10).select(
        "player_id", "game_id", "team")
