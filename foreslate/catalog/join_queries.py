"""J-rows: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import histories as H
from ..operators import reshape as U
from ..operators.scans import asof_backward, latest_per_clock, prefix_totals, prior_baseline
from ..plans import features as FT
from ..plans import passers as P
from ..plans import players as PL
from ..plans import reports as RP
from . import frames as R
from .registry import query
from .shared_sql import SUMMARY, band_case, fair, phi

_DEF = [f"def_{s}" for s in SUMMARY]
_OFF = [f"off_{s}" for s in SUMMARY]


@query("j1_opponent_lookup", floats="off_plays", ints="game_id", views="offence",
       sql="SELECT game_id, team, opponent, off_plays FROM offence")
def _(fx):
    plays = A.scrimmage_plays(R.flagged_plays(fx))
    return plays.groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.count("*").cast("double").alias("off_plays"), F.min_by("defteam", "seq").alias("opponent"))


@query("j2_mirrored_defence", floats=" ".join(_OFF + _DEF), ints="game_id season week", views="team_games",
       sql=f"SELECT game_id, season, week, team, opponent, {', '.join(_OFF + _DEF)} FROM team_games")
def _(fx):
    return A.team_games(R.flagged_plays(fx), min_plays=1).select(
        "game_id", "season", "week", "team", "opponent", *_OFF, *_DEF)


@query("j3_stats_on_schedule", floats="points_for off_epa_play def_epa_play", ints="game_id", views="observed",
       sql="SELECT game_id, team, points_for, off_epa_play, def_epa_play FROM observed")
def _(fx):
    return FT.team_observations(fx.games, R.team_games(fx)).select(
        "game_id", "team", "points_for", "off_epa_play", "def_epa_play")


@query("j4_baseline_lookup", floats="baseline", ints="game_id season", views="observed baselines",
       sql="SELECT o.game_id, o.team, o.season, b.points_for AS baseline FROM observed o LEFT JOIN baselines b USING (season)")
def _(fx):
    base = prior_baseline(R.observed(fx), ["points_for"]).withColumnRenamed("points_for", "baseline")
    return R.observed(fx).select("game_id", "team", "season").join(base, "season", "left")


@query("j5_feature_assembly", floats="home_off_epa_play away_off_epa_play home_points_for away_points_for "
       "home_form_games away_form_games", ints="game_id", views="paired",
       sql="SELECT game_id, home_off_epa_play, away_off_epa_play, home_points_for, away_points_for, "
           "home_form_games, away_form_games FROM paired")
def _(fx):
    return R.paired_on(fx, ("off_epa_play", "points_for")).select("game_id", "home_off_epa_play", "away_off_epa_play",
        "home_points_for", "away_points_for", "home_form_games", "away_form_games")


@query("j6_passer_terms_on_games", floats="qb_delta qb_edge availability_edge", ints="game_id",
       views="games passer_terms availability_terms",
       sql="""SELECT g.game_id, coalesce(p.qb_delta, 0) AS qb_delta, coalesce(p.qb_edge, 0) AS qb_edge,
              coalesce(a.availability_edge, 0) AS availability_edge
              FROM games g LEFT JOIN passer_terms p USING (game_id) LEFT JOIN availability_terms a USING (game_id)""")
def _(fx):
    passer = P.passer_features(fx.games, R.player_weeks(fx), 1)
    absent = P.availability_features(fx.games, R.player_weeks(fx), R.injuries(fx))
    return fx.games.select("game_id").join(passer, "game_id", "left").join(absent, "game_id", "left")


@query("j7_half_scores_once", floats="home_first_half away_first_half", ints="game_id", views="games halves",
       sql="SELECT g.game_id, h.home_first_half, h.away_first_half FROM games g LEFT JOIN halves h USING (game_id)")
def _(fx):
    twice = R.halves(fx).unionByName(R.halves(fx))
    return FT.attach_halves(fx.games, twice).select("game_id", "home_first_half", "away_first_half")


@query("j8_asof_strict", floats="qb_rating_pre", ints="game_id player_id period", views="starters",
       sql="SELECT game_id, team, player_id, period, qb_rating_pre FROM starters")
def _(fx):
    return P.starter_ratings(fx.games, P.passer_ratings(R.player_weeks(fx), 1)).select(
        "game_id", "team", "player_id", "period", "qb_rating_pre")


@query("j8_asof_strict_events", floats="seen", ints="event_id", views="log", sql="""
SELECT l.entity, l.event_id, r.value AS seen FROM (SELECT * FROM log WHERE event_type <> 'click') l
ASOF LEFT JOIN (SELECT entity, ts, arg_max(value, event_id) AS value FROM log WHERE event_type = 'click' AND value IS NOT NULL GROUP BY entity, ts) r
  ON r.entity = l.entity AND l.ts > r.ts""")
def _(fx):
    clicks = fx.events.where((F.col("event_type") == "click") & F.col("value").isNotNull())
    clicks = clicks.groupBy("entity", "ts").agg(F.max_by("value", "event_id").alias("seen"))
    others = fx.events.where(F.col("event_type") != "click").select("entity", "event_id", "ts")
    return asof_backward(others, clicks, key=["entity"], clock="ts", values=["seen"]).drop("ts")


@query("j9_asof_report_usage", floats="availability usage_post", ints="season week gsis_id", views="listed_usage",
       sql="SELECT season, week, team, gsis_id, availability, usage_post FROM listed_usage")
def _(fx):
    usage = P.player_usage(R.player_weeks(fx))
    timeline = latest_per_clock(usage, ["player_id"], "period", ["game_id", "team"], ["usage_post"])
    report = R.injuries(fx).select(
        "season", "week", "team", F.col("gsis_id").alias("player_id"), "availability",
        S.period(F.col("season"), F.col("week")).alias("period"))
    return asof_backward(report, timeline, key=["player_id"], clock="period", values=["usage_post"]).select(
        "season", "week", "team", F.col("player_id").alias("gsis_id"), "availability", "usage_post")


@query("j10_expanding_join", floats="margin_sum", ints="cutoff history", views="games", sql="""
SELECT c.cutoff, count(*) AS history, sum(g.margin) AS margin_sum
FROM (SELECT season, min(season * 100 + week) AS cutoff FROM games GROUP BY season) c
JOIN games g ON g.season * 100 + g.week < c.cutoff WHERE g.completed GROUP BY c.cutoff""")
def _(fx):
    clocked = fx.games.withColumn("period", S.period(F.col("season"), F.col("week")))
    cutoffs = clocked.groupBy("season").agg(F.min("period").alias("cutoff"))
    return H.expanding_states(clocked.where("completed"), cutoffs, "period", "cutoff", {
        "history": H.counted(F.lit(True)), "margin_sum": H.total(F.col("margin"))}).where("history > 0")


@query("j10_expanding_extremes", floats="least_margin most_margin", ints="cutoff history home_wins", views="games", sql="""
SELECT c.cutoff, count(g.game_id) AS history, count(*) FILTER (WHERE g.margin > 0) AS home_wins,
       min(g.margin) AS least_margin, max(g.margin) AS most_margin
FROM (SELECT DISTINCT season * 100 + week AS cutoff FROM games WHERE season IS NOT NULL AND week IS NOT NULL) c
LEFT JOIN games g ON g.season * 100 + g.week < c.cutoff AND g.completed GROUP BY c.cutoff""")
def _(fx):
    clocked = fx.games.withColumn("period", S.period(F.col("season"), F.col("week")))
    margin = F.col("margin")
    return H.expanding_states(clocked.where("completed"), clocked.withColumnRenamed("period", "cutoff"), "period", "cutoff", {
        "history": H.counted(F.lit(True)), "home_wins": H.counted(margin > 0), "least_margin": H.least(margin), "most_margin": H.greatest(margin)})


@query("j10_prefix_totals", floats="margin_sum", ints="period history", views="games", sql="""
SELECT period, coalesce(sum(n) OVER w, 0) AS history, coalesce(sum(t) OVER w, 0) AS margin_sum
FROM (SELECT season * 100 + week AS period, count(*) FILTER (WHERE completed) AS n, coalesce(sum(margin), 0) AS t FROM games GROUP BY 1)
WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(fx):
    clocked = fx.games.withColumn("period", S.period(F.col("season"), F.col("week")))
    return prefix_totals(clocked, "period", {
        "history": F.count_if("completed"), "margin_sum": F.coalesce(F.sum("margin"), F.lit(0.0))})


@query("j11_covered_seasons", ints="season games", views="games injuries", sql="""
SELECT season, count(*) AS games, season IN (SELECT season FROM injuries) AS covered FROM games GROUP BY season""")
def _(fx):
    covered = fx.injuries.select("season").distinct().withColumn("covered", F.lit(True))
    return fx.games.groupBy("season").agg(F.count("*").alias("games")).join(covered, "season", "left").fillna(
        False, ["covered"])


@query("j12_costs_on_schedule", floats="home_cost away_cost", ints="game_id", views="games absence", sql="""
SELECT g.game_id, h.cost AS home_cost, a.cost AS away_cost FROM games g
LEFT JOIN absence h ON h.season = g.season AND h.week = g.week AND h.team = g.home_team
LEFT JOIN absence a ON a.season = g.season AND a.week = g.week AND a.team = g.away_team""")
def _(fx):
    cost = R.absence(fx).select("season", "week", "team", "cost")
    out = fx.games.select("game_id", "season", "week", "home_team", "away_team")
    for side in ("home", "away"):
        out = out.join(cost.withColumnsRenamed({"team": f"{side}_team", "cost": f"{side}_cost"}),
                       ["season", "week", f"{side}_team"], "left")
    return out.select("game_id", "home_cost", "away_cost")


@query("j13_defence_on_players", floats="opp_pass_yards_allowed opp_rush_yards_allowed", ints="player_id game_id",
       views="player_weeks allowed_form", sql="""
SELECT p.player_id, p.game_id, p.team, a.opp_pass_yards_allowed, a.opp_rush_yards_allowed
FROM player_weeks p LEFT JOIN allowed_form a ON a.team = p.opponent_team AND a.season = p.season AND a.week = p.week""")
def _(fx):
    allowed = PL.defence_form(R.player_weeks(fx)).withColumnRenamed("team", "opponent_team")
    return R.player_weeks(fx).join(allowed, ["opponent_team", "season", "week"], "left").select(
        "player_id", "game_id", "team", "opp_pass_yards_allowed", "opp_rush_yards_allowed")


@query("j14_schedule_on_players", floats="is_home", ints="player_id game_id", views="player_weeks games", sql="""
SELECT p.player_id, p.game_id, p.team, CAST(p.team = g.home_team AS INT) AS is_home
FROM player_weeks p LEFT JOIN games g USING (game_id)""")
def _(fx):
    return PL.attach_schedule(R.player_weeks(fx), fx.games).select("player_id", "game_id", "team", "is_home")


@query("j15_report_on_players", floats="availability", ints="player_id game_id", views="player_weeks one_listing", sql="""
SELECT p.player_id, p.game_id, p.team, coalesce(r.availability, 1) AS availability
FROM player_weeks p LEFT JOIN one_listing r ON r.season = p.season AND r.week = p.week AND r.player_id = p.player_id""")
def _(fx):
    return PL.attach_availability(R.player_weeks(fx), R.injuries(fx)).select(
        "player_id", "game_id", "team", "availability")


@query("j16_projected_points", floats="team_proj_points opp_proj_points", ints="player_id game_id",
       views="player_weeks scored", sql="""
WITH pts AS (SELECT game_id, home_team AS team, (pred_total + pred_margin) / 2.0 AS pts FROM scored
             UNION ALL SELECT game_id, away_team, (pred_total - pred_margin) / 2.0 FROM scored)
SELECT p.player_id, p.game_id, p.team, coalesce(a.pts, 22.5) AS team_proj_points, coalesce(b.pts, 22.5) AS opp_proj_points
FROM player_weeks p LEFT JOIN pts a ON a.game_id = p.game_id AND a.team = p.team
LEFT JOIN pts b ON b.game_id = p.game_id AND b.team = p.opponent_team""")
def _(fx):
    points = U.projected_points(R.with_team_totals(fx))
    return PL.attach_points(R.player_weeks(fx), points).select(
        "player_id", "game_id", "team", "team_proj_points", "opp_proj_points")


ROSTER_SQL = """
SELECT DISTINCT player_id, team FROM player_weeks
WHERE season * 100 + week < 200020 AND season * 100 + week >= 200016
  AND team IN (SELECT home_team FROM games WHERE season = 2000 AND week = 20
               UNION SELECT away_team FROM games WHERE season = 2000 AND week = 20)"""
SLATE_SQL = """
SELECT game_id, home_team AS team, away_team AS opponent_team FROM games WHERE season = 2000 AND week = 20
UNION ALL SELECT game_id, away_team, home_team FROM games WHERE season = 2000 AND week = 20"""


@query("j17_roster_on_slate", ints="player_id game_id", views="games player_weeks",
       sql=f"SELECT r.player_id, r.team, s.game_id, s.opponent_team FROM ({ROSTER_SQL}) r JOIN ({SLATE_SQL}) s USING (team)")
def _(fx):
    slate = fx.games.where("season = 2000 AND week = 20")
    roster = U.roster_before(R.player_weeks(fx), 2000, 20, U.team_universe(slate))
    return U.slate_player_rows(roster, slate).select("player_id", "team", "game_id", "opponent_team")


@query("j18_semi_and_anti", ints="season inside outside", views="games player_weeks", sql="""
SELECT season, count(*) FILTER (WHERE n) AS inside, count(*) FILTER (WHERE NOT n) AS outside
FROM (SELECT p.season, p.game_id IN (SELECT game_id FROM games WHERE neutral) AS n FROM player_weeks p) GROUP BY season""")
def _(fx):
    rows, wanted = R.player_weeks(fx).select("season", "game_id"), fx.games.where("neutral").select("game_id")
    inside = rows.join(wanted, "game_id", "left_semi").groupBy("season").agg(F.count("*").alias("inside"))
    outside = rows.join(wanted, "game_id", "left_anti").groupBy("season").agg(F.count("*").alias("outside"))
    return inside.join(outside, "season", "full").fillna(0, ["inside", "outside"])


@query("j19_band_lookup", floats="strength band_rate", ints="game_id band_games", views="edges", sql=f"""
SELECT game_id, pick_prob AS strength, {band_case('pick_prob', K.CALIBRATION_BANDS, 1)} AS band_games,
       {band_case('pick_prob', K.CALIBRATION_BANDS, 2)} AS band_rate FROM edges""")
def _(fx):
    sample, rate = RP.band_lookup(F.col("pick_prob"), K.CALIBRATION_BANDS)
    return R.priced(fx).select("game_id", F.col("pick_prob").alias("strength"),
                               sample.alias("band_games"), rate.alias("band_rate"))


PAIR_SQL = f"""
SELECT *, 1.0 - home_prob AS away_prob, {fair('home_prob')} AS home_fair, {fair('(1.0 - home_prob)')} AS away_fair
FROM (SELECT *, {phi('(spread / 13.2)')} AS home_prob, (total + spread) / 2.0 AS home_total, (total - spread) / 2.0 AS away_total
FROM (SELECT p.home_team, p.away_team, p.neutral, (he.elo - ae.elo) / 25.0 + CASE WHEN p.neutral THEN 0 ELSE 1.95 END AS spread,
             (h.points_for + a.points_against) / 2.0 + (a.points_for + h.points_against) / 2.0 AS total
      FROM (SELECT DISTINCT home_team, away_team, neutral FROM games) p
      LEFT JOIN team_table h ON h.team = p.home_team LEFT JOIN team_table a ON a.team = p.away_team
      LEFT JOIN stand_in_elo he ON he.team = p.home_team LEFT JOIN stand_in_elo ae ON ae.team = p.away_team))"""
PAIR_FLOATS = "spread total home_prob away_prob home_fair away_fair home_total away_total"


@query("j20_pair_projection", floats=PAIR_FLOATS, views="games team_table stand_in_elo",
       sql=f"SELECT home_team, away_team, neutral, {PAIR_FLOATS.replace(' ', ', ')} FROM ({PAIR_SQL})")
def _(fx):
    pairs = fx.games.select("home_team", "away_team", "neutral").distinct()
    return RP.pair_projection(pairs, R.team_data(fx)).select("home_team", "away_team", "neutral", *PAIR_FLOATS.split())


@query("j21_pair_on_slate", floats="spread pred_margin prob_home pred_total", ints="season week", views="games team_table stand_in_elo scored", sql=f"""
SELECT p.home_team, p.away_team, p.neutral, p.spread, s.season, s.week, s.pred_margin, s.prob_home, s.pred_total,
       CASE WHEN s.game_id IS NULL THEN 'not on this slate' ELSE 'on this slate' END AS status
FROM ({PAIR_SQL}) p LEFT JOIN (SELECT * FROM scored WHERE NOT completed) s
  ON s.home_team = p.home_team AND s.away_team = p.away_team""")
def _(fx):
    pairs = fx.games.select("home_team", "away_team", "neutral").distinct()
    projected = RP.pair_projection(pairs, R.team_data(fx))
    return RP.pair_slate_lookup(projected, R.scored(fx).where("NOT completed")).select(
        "home_team", "away_team", "neutral", "spread", "season", "week", "pred_margin", "prob_home",
        "pred_total", "status")
