"""T- and U-rows: ordering, top-k, slate selection, unpivots and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import rating as RT
from ..operators import reshape as U
from ..operators.ranks import place_in_group
from ..plans import players as PL
from ..plans import walkforward as WF
from . import frames as R
from .join_queries import ROSTER_SQL, SLATE_SQL
from .registry import query


@query("t1_chronological_order", ints="game_id season week place", views="games", sql="""
SELECT game_id, season, week, row_number() OVER (PARTITION BY season, week ORDER BY kickoff, game_id) AS place FROM games""")
def _(fx):
    games = fx.games.select("game_id", "season", "week", "kickoff")
    return place_in_group(games, ["season", "week"], [("kickoff", False), ("game_id", False)], "place").drop("kickoff")


@query("t2_slate_orders", ints="game_id season week by_confidence by_total by_margin", views="edges", sql="""
SELECT game_id, season, week, row_number() OVER (PARTITION BY season, week ORDER BY round(pick_prob, 9) DESC, game_id) AS by_confidence,
       row_number() OVER (PARTITION BY season, week ORDER BY round(pred_total, 9) DESC, game_id) AS by_total,
       row_number() OVER (PARTITION BY season, week ORDER BY round(pred_margin, 9) DESC, game_id) AS by_margin FROM edges""")
def _(fx):
    # one row for each of the three orders, so one sort places all
    orders = {"by_confidence": "pick_prob", "by_total": "pred_total", "by_margin": "pred_margin"}
    long = R.priced(fx).select("game_id", "season", "week", F.explode(F.array(*[
        F.struct(F.lit(o).alias("kind"), F.round(c, 9).alias("value")) for o, c in orders.items()])).alias("of"))
    placed = place_in_group(long, ["season", "week", "of.kind"], [("of.value", True), ("game_id", False)], "place")
    return placed.groupBy("game_id", "season", "week").agg(
        *[F.max(F.when(F.col("of.kind") == o, F.col("place"))).alias(o) for o in orders])


@query("t3_top_players", floats="value", ints="player_id game_id rank", views="player_weeks", sql="UNION ALL ".join(
    f"""SELECT player_id, game_id, team, category, value, rank FROM (SELECT player_id, game_id, team, '{t}' AS category, {t} AS value,
        row_number() OVER (ORDER BY round({t}, 9) DESC, player_id, game_id, team) AS rank FROM player_weeks WHERE {t} > 0) WHERE rank <= 12 """
    for t in K.PLAYER_TARGETS))
def _(fx):
    return U.top_per_category(R.player_weeks(fx), list(K.PLAYER_TARGETS), 12,
                              ["player_id", "game_id", "team"], ["player_id", "game_id", "team"])


@query("t4_head_ratings", floats="elo spread_vs_average", views="final_ratings",
       sql="SELECT * FROM final_ratings ORDER BY elo DESC, team LIMIT 10")
def _(fx):
    return RT.current_ratings(RT.rating_pass(fx.games)[1]).orderBy(F.desc("elo"), "team").limit(10)


@query("t5_target_slate", ints="season week", views="games", sql="""
WITH s AS (SELECT season, week, avg(CAST(completed AS INT)) AS played FROM games GROUP BY season, week),
p AS (SELECT *, row_number() OVER (ORDER BY season, week) AS r FROM s WHERE played < 1)
SELECT season, week FROM p WHERE r = CASE WHEN (SELECT played FROM p WHERE r = 1) >= 0.5 AND (SELECT count(*) FROM p) > 1 THEN 2 ELSE 1 END""")
def _(fx):
    return U.target_slate(fx.games)


@query("t6_slate_grid", ints="period", views="games",
       sql="SELECT DISTINCT season * 100 + week AS period FROM games WHERE completed AND season >= 1997")
def _(fx):
    return U.slate_grid(fx.games, 1997)


@query("u1_team_unpivot", floats="points_for points_against", ints="game_id season week", views="sides_long",
       sql="SELECT game_id, season, week, team, opponent, is_home, points_for, points_against FROM sides_long")
def _(fx):
    return U.team_points_long(fx.games).drop("kickoff")


@query("u2_listed_starters", ints="game_id player_id period", views="listed",
       sql="SELECT game_id, team, player_id, period FROM listed WHERE player_id IS NOT NULL")
def _(fx):
    return U.listed_starters(fx.games).select("game_id", "team", "player_id", "period")


@query("u3_recent_roster", ints="player_id appearances", views="games player_weeks",
       sql=f"""SELECT p.player_id, p.team, count(*) AS appearances FROM player_weeks p JOIN ({ROSTER_SQL}) r
               ON r.player_id = p.player_id AND r.team = p.team
               WHERE p.season * 100 + p.week < 200020 AND p.season * 100 + p.week >= 200016 GROUP BY p.player_id, p.team""")
def _(fx):
    slate = fx.games.where("season = 2000 AND week = 20")
    return U.roster_before(R.player_weeks(fx), 2000, 20, U.team_universe(slate))


@query("u4_slate_rows", floats="form_rec_yards form_targets", ints="player_id game_id form_games", views="games player_weeks",
       sql=f"""
WITH past AS (SELECT * FROM player_weeks WHERE season * 100 + week < 200020),
f AS (SELECT player_id, count(*) AS form_games,
             list(receiving_yards ORDER BY season, week, game_id, team, opponent_team) AS ry,
             list(targets ORDER BY season, week, game_id, team, opponent_team) AS tg FROM past GROUP BY player_id),
e AS (SELECT player_id, form_games, list_reduce(ry, lambda s, v: s * 0.65 + v) AS a, list_reduce(tg, lambda s, v: s * 0.65 + v) AS b FROM f)
-- a second game of the same slate decays the first one's empty row
SELECT player_id, game_id, team, form_games + k AS form_games,
       a * pow(0.65, k) * 0.35 / (1 - pow(0.65, form_games + k)) AS form_rec_yards,
       b * pow(0.65, k) * 0.35 / (1 - pow(0.65, form_games + k)) AS form_targets
FROM (SELECT r.player_id, r.team, s.game_id, e.form_games, e.a, e.b,
             row_number() OVER (PARTITION BY r.player_id ORDER BY s.game_id, r.team, s.opponent_team) - 1 AS k
      FROM ({ROSTER_SQL}) r JOIN ({SLATE_SQL}) s USING (team) JOIN e USING (player_id))""")
def _(fx):
    _, rows = PL.player_frames(R.player_weeks(fx), fx.games, 2000, 20, R.injuries(fx))
    return rows.select("player_id", "game_id", "team", "form_games", "form_rec_yards", "form_targets")


@query("u5_projected_points", floats="proj_points", ints="game_id", views="scored", sql="""
SELECT game_id, home_team AS team, (pred_total + pred_margin) / 2.0 AS proj_points FROM scored
UNION ALL SELECT game_id, away_team, (pred_total - pred_margin) / 2.0 FROM scored""")
def _(fx):
    frame = R.with_team_totals(fx)
    return U.projected_points(frame.unionByName(frame))


@query("u6_team_universe", views="games",
       sql="SELECT home_team AS team FROM games UNION SELECT away_team FROM games")
def _(fx):
    return U.team_universe(fx.games)


@query("u7_scored_union", ints="season rows", views="scored",
       sql="SELECT season, count(*) AS rows FROM scored WHERE completed GROUP BY season")
def _(fx):
    scored = R.settled(fx)
    seasons = [r["season"] for r in scored.select("season").distinct().orderBy("season").collect()]
    frames = [scored.where(F.col("season") == s) for s in seasons]  # as a replay scores them, one cutoff each
    return WF._stack(frames).groupBy("season").agg(F.count("*").alias("rows"))
