"""Views shared by several oracles (DuckDB text), with what each one needs."""

from __future__ import annotations

from .. import constants as K
from ..functions import normal as N

SUMMARY = ("plays", "drives", "plays_per_drive", "epa_play", "pass_epa", "rush_epa", "success",
           "explosive", "turnover_rate", "sack_rate", "pass_rate")


def horner(x: str, coefficients) -> str:
    out = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def phi(z: str) -> str:
    t = f"(1.0 / (1.0 + {N.PHI_P!r} * abs({z})))"
    upper = f"(exp(-abs({z}) * abs({z}) / 2.0) * CAST(0.3989422804014327 AS DOUBLE) * {t} * {horner(t, N.PHI_B)})"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {upper} ELSE {upper} END)"


def clip(x: str, lo, hi) -> str:
    return f"(CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


def logit(p: str) -> str:
    c = clip(p, "CAST(1e-6 AS DOUBLE)", "CAST(0.999999 AS DOUBLE)")
    return f"ln({c} / (1.0 - {c}))"


def implied(odds: str) -> str:
    return f"(CASE WHEN {odds} > 0 THEN 100.0 / ({odds} + 100.0) ELSE -{odds} / (-{odds} + 100.0) END)"


def payout(odds: str) -> str:
    return f"(CASE WHEN {odds} > 0 THEN {odds} / 100.0 ELSE 100.0 / abs({odds}) END)"


def fair(p: str) -> str:
    c = clip(p, "CAST(1e-6 AS DOUBLE)", "CAST(0.999999 AS DOUBLE)")
    return f"(CASE WHEN {c} >= 0.5 THEN -100.0 * {c} / (1.0 - {c}) ELSE 100.0 * (1.0 - {c}) / {c} END)"


def label(x: str, tiers, missing: str = "NULL") -> str:
    whens = " ".join(f"WHEN {x} >= {b} THEN '{t}'" for b, t in tiers)
    return f"(CASE WHEN {x} IS NULL THEN {missing} {whens} ELSE '{tiers[-1][1]}' END)"


def hit(p: str, y: str = "home_win") -> str:
    return f"(CASE WHEN {y} = 0.5 THEN 0.5 WHEN {p} > 0.5 THEN {y} ELSE 1.0 - {y} END)"


def floored(p: str) -> str:
    return clip(p, "CAST(1e-9 AS DOUBLE)", "CAST(0.999999999 AS DOUBLE)")


def ewma_prior(x: str, alpha: float, window: str) -> str:
    """Recursive fold over the earlier non-null values, by ``list_reduce``."""
    seen = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN len({seen}) > 0 THEN list_reduce({seen}, lambda s, v: s + {alpha} * (v - s)) END"


def mean_prior(x: str, alpha: float, window: str) -> str:
    """Bias-corrected weighted mean over the earlier values, by two folds."""
    seen = f"list(CAST({x} AS DOUBLE)) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    b = 1 - alpha
    top = f"list_reduce({seen}, lambda s, v: s * {b} + v)"
    bottom = f"list_reduce(list_transform({seen}, lambda v: CAST(1 AS DOUBLE)), lambda s, v: s * {b} + v)"
    return f"CASE WHEN len({seen}) > 0 THEN {top} / {bottom} END"


def baseline(table: str, stats, season: str = "season", by: str = "") -> str:
    """Prior-seasons-only mean per season, own mean where there is no history."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    w = f"OVER ({part}ORDER BY {season} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inner = ", ".join(f"sum({s}) AS {s}_t, count({s}) AS {s}_n" for s in stats)
    outer = ", ".join(
        f"CASE WHEN coalesce(sum({s}_n) {w}, 0) > 0 THEN coalesce(sum({s}_t) {w}, 0) / sum({s}_n) {w} "
        f"WHEN {s}_n > 0 THEN {s}_t / {s}_n END AS {s}" for s in stats)
    return f"SELECT {lead}{season}, {outer} FROM (SELECT {lead}{season}, {inner} FROM {table} GROUP BY {lead}{season})"


_OFF = ", ".join(f"o.off_{s}" for s in SUMMARY)
_DEF = ", ".join(f"d.off_{s} AS def_{s}" for s in SUMMARY)
_ROLL = K.ROLLED_STATS
_BLOCK = "PARTITION BY team, season ORDER BY week, kickoff, game_id, is_home"

_FORM = ", ".join(
    f"CASE WHEN now_{s} IS NULL THEN {K.FORM_CARRY} * p.last_{s} "
    f"WHEN p.last_{s} IS NULL THEN now_{s} "
    f"ELSE least(form_games / {K.FORM_FULL_GAMES}, 1.0) * now_{s} "
    f"+ (1.0 - least(form_games / {K.FORM_FULL_GAMES}, 1.0)) * {K.FORM_CARRY} * p.last_{s} END AS {s}"
    for s in _ROLL)

SHARED_SQL: dict[str, tuple[str, ...]] = {
    "scrimmage": ("plays", """
SELECT game_id, season, week, posteam, defteam, epa, success, sack, drive, seq,
       CAST(play_type = 'pass' AS INT) AS is_pass, CAST(play_type = 'run' AS INT) AS is_run,
       CASE WHEN yards_gained >= 20 THEN 1.0 ELSE 0.0 END AS explosive,
       least(interception, 1.0) AS turnover
FROM plays WHERE play_type IN ('pass', 'run') AND epa IS NOT NULL
  AND posteam IS NOT NULL AND defteam IS NOT NULL"""),
    "offence": ("scrimmage", """
SELECT game_id, season, week, posteam AS team, arg_min(defteam, seq) AS opponent,
       CAST(count(*) AS DOUBLE) AS off_plays, CAST(count(DISTINCT drive) AS DOUBLE) AS off_drives,
       count(*) * 1.0 / count(DISTINCT drive) AS off_plays_per_drive,
       avg(epa) AS off_epa_play,
       avg(epa) FILTER (WHERE is_pass = 1) AS off_pass_epa,
       avg(epa) FILTER (WHERE is_run = 1) AS off_rush_epa,
       avg(success) AS off_success, avg(explosive) AS off_explosive, avg(turnover) AS off_turnover_rate,
       coalesce(avg(sack) FILTER (WHERE is_pass = 1), 0) AS off_sack_rate,
       avg(is_pass) AS off_pass_rate
FROM scrimmage GROUP BY game_id, season, week, posteam"""),
    "team_games": ("offence", f"""
SELECT o.game_id, o.season, o.week, o.team, o.opponent, {_OFF}, {_DEF}
FROM (SELECT * FROM offence WHERE off_plays >= 1) o
LEFT JOIN (SELECT * FROM offence WHERE off_plays >= 1) d
  ON d.game_id = o.game_id AND d.team = o.opponent"""),
    "scored_plays": ("plays contests", """
SELECT p.*, k.home_team, k.away_team,
       sum(CASE WHEN posteam = home_team THEN yards_gained ELSE 0 END) OVER w AS total_home_score,
       sum(CASE WHEN posteam = away_team THEN yards_gained ELSE 0 END) OVER w AS total_away_score
FROM plays p JOIN contests k USING (game_id)
WINDOW w AS (PARTITION BY game_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""),
    "halves": ("scored_plays", """
SELECT game_id, season, max(total_home_score) AS home_first_half, max(total_away_score) AS away_first_half
FROM scored_plays WHERE qtr <= 2 GROUP BY game_id, season"""),
    "sides_long": ("games", """
SELECT game_id, league, season, week, kickoff, home_team AS team, away_team AS opponent,
       home_score AS points_for, away_score AS points_against, TRUE AS is_home FROM games
UNION ALL
SELECT game_id, league, season, week, kickoff, away_team, home_team, away_score, home_score, FALSE FROM games"""),
    "observed": ("sides_long team_games", f"""
SELECT s.game_id, s.season, s.week, s.kickoff, s.team, s.is_home, s.points_for, s.points_against,
       {', '.join('t.' + c for c in _ROLL if not c.startswith('points_'))}
FROM sides_long s LEFT JOIN team_games t ON t.game_id = s.game_id AND t.team = s.team"""),
    "baselines": ("observed", baseline("observed", _ROLL)),
    "centered": ("observed baselines", f"""
SELECT o.game_id, o.season, o.week, o.kickoff, o.team, o.is_home,
       {', '.join(f'o.{s} - b.{s} AS {s}' for s in _ROLL)}
FROM observed o LEFT JOIN baselines b ON b.season = o.season"""),
    # last season's final value of the never-reset recurrence
    "season_lists": ("centered", f"""
SELECT team, season, {', '.join(f'''coalesce(list({s} ORDER BY week, kickoff, game_id, is_home) FILTER (WHERE {s} IS NOT NULL), []) AS {s}''' for s in _ROLL)}
FROM centered GROUP BY team, season"""),
    "season_finals": ("season_lists", f"""
SELECT team, season, {', '.join(
        f"CASE WHEN len(l_{s}) > 0 THEN list_reduce(l_{s}, lambda s, v: s + {K.FORM_ALPHA} * (v - s)) END AS last_{s}"
        for s in _ROLL)}
FROM (SELECT team, season, {', '.join(
        f"flatten(list({s}) OVER (PARTITION BY team ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS l_{s}"
        for s in _ROLL)} FROM season_lists)"""),
    "in_season": ("centered", f"""
SELECT game_id, team, is_home, season,
       count({_ROLL[0]}) OVER ({_BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS form_games,
       {', '.join(ewma_prior(s, K.FORM_ALPHA, _BLOCK) + f' AS now_{s}' for s in _ROLL)}
FROM centered"""),
    "form": ("in_season season_finals", f"""
SELECT i.game_id, i.team, i.is_home, CAST(form_games AS DOUBLE) AS form_games, {_FORM}
FROM in_season i LEFT JOIN season_finals p ON p.team = i.team AND p.season = i.season"""),
    "paired": ("games form", f"""
SELECT g.*, h.form_games AS home_form_games, a.form_games AS away_form_games,
       {', '.join(f'h.{s} AS home_{s}, a.{s} AS away_{s}' for s in _ROLL)}
FROM games g
LEFT JOIN form h ON h.game_id = g.game_id AND h.team = g.home_team
LEFT JOIN form a ON a.game_id = g.game_id AND a.team = g.away_team"""),
    # stand-in forecasts with exact arithmetic, so grading has exact answers
    "scored": ("games halves", f"""
SELECT *, CASE WHEN market_prob_home IS NULL THEN model_prob_home
          ELSE 1.0 / (1.0 + exp(-(0.1 * {logit('model_prob_home')} + 0.9 * {logit('market_prob_home')}))) END AS prob_home
FROM (
  SELECT *, 1.0 / (1.0 + exp(-model_margin / 7.0)) AS model_prob_home,
         1.0 / (1.0 + exp(-noise / 4.0)) AS elo_prob_home,
         {implied('home_moneyline')} / ({implied('home_moneyline')} + {implied('away_moneyline')}) AS market_prob_home,
         CASE WHEN market_spread IS NULL THEN model_margin ELSE 0.1 * model_margin + 0.9 * market_spread END AS pred_margin,
         CASE WHEN market_total IS NULL THEN model_total ELSE 0.1 * model_total + 0.9 * market_total END AS pred_total
  FROM (
    SELECT g.*, h.home_first_half, h.away_first_half,
           h.home_first_half + h.away_first_half AS first_half_total,
           h.home_first_half - h.away_first_half AS first_half_margin,
           g.spread_line AS market_spread, g.total_line AS market_total,
           g.home_score + g.away_score AS actual_total,
           ((g.game_id * 37) % 101 - 50) / 10.0 AS noise,
           coalesce(g.spread_line, 0.0) * 0.8 + ((g.game_id * 37) % 101 - 50) / 10.0 AS model_margin,
           coalesce(g.total_line, 100.0) * 0.85 + 15.0 + ((g.game_id * 53) % 41 - 20) / 4.0 AS model_total
    FROM games g LEFT JOIN halves h ON h.game_id = g.game_id
  )
)"""),
    "graded": ("scored", f"""
SELECT *, CASE WHEN {floored('prob_home')} >= 0.5 THEN home_team ELSE away_team END AS pick,
       greatest({floored('prob_home')}, 1.0 - {floored('prob_home')}) AS pick_prob,
       CAST({hit(floored('prob_home'))} AS DOUBLE) AS hit,
       CASE WHEN market_spread IS NULL OR margin - market_spread = 0 THEN NULL
            WHEN (pred_margin - market_spread > 0) = (margin - market_spread > 0) THEN 1.0 ELSE 0.0 END AS ats_win,
       CASE WHEN market_total IS NULL OR actual_total - market_total = 0 THEN NULL
            WHEN (model_total - market_total > 0) = (actual_total - market_total > 0) THEN 1.0 ELSE 0.0 END AS ou_win,
       CASE WHEN market_total IS NULL THEN '-' WHEN model_total - market_total > 0 THEN 'OVER' ELSE 'UNDER' END AS ou_pick,
       abs(actual_total - pred_total) AS total_error
FROM scored WHERE completed"""),
    "edges": ("scored", f"""
SELECT *, CASE WHEN prob_home >= 0.5 THEN home_team ELSE away_team END AS pick,
       greatest(prob_home, 1.0 - prob_home) AS pick_prob,
       {label('greatest(prob_home, 1.0 - prob_home)', K.CONFIDENCE_TIERS, "'UNKNOWN'")} AS confidence,
       pred_margin - market_spread AS spread_edge,
       CASE WHEN market_spread IS NULL THEN '-' WHEN pred_margin - market_spread > 0 THEN home_team ELSE away_team END AS ats_pick,
       {fair('prob_home')} AS fair_home_ml, {fair('(1.0 - prob_home)')} AS fair_away_ml,
       CASE WHEN prob_home >= 0.5 THEN home_moneyline ELSE away_moneyline END AS pick_odds,
       coalesce((prob_home >= 0.5) <> (market_prob_home >= 0.5), FALSE) AS disagrees_with_market
FROM scored"""),
    "priced": ("edges", f"""
SELECT *, pick_prob * {payout('pick_odds')} - (1.0 - pick_prob) AS ml_ev,
       greatest(coalesce((pick_prob * {payout('pick_odds')} - (1.0 - pick_prob)) / {payout('pick_odds')} * 0.25, 0.0), 0.0) AS kelly,
       model_total - market_total AS model_edge, pred_total - market_total AS total_edge,
       CASE WHEN market_total IS NULL THEN '-' WHEN pred_total > market_total THEN 'OVER' ELSE 'UNDER' END AS ou_pick
FROM edges"""),
}

SHARED_SQL.update({
    "usage": ("player_weeks", """
SELECT *, avg(touches) OVER (PARTITION BY player_id ORDER BY season, week, game_id, team ROWS UNBOUNDED PRECEDING) AS usage_post
FROM (SELECT player_id, season, week, game_id, team, season * 100 + week AS period, targets + carries AS touches
      FROM player_weeks WHERE targets + carries > 0)"""),
    "player_timeline": ("usage", """
SELECT player_id, period, usage_post FROM usage
QUALIFY row_number() OVER (PARTITION BY player_id, period ORDER BY game_id DESC, team DESC) = 1"""),
    "team_timeline": ("usage", "SELECT team, period, sum(usage_post) AS team_usage FROM usage GROUP BY team, period"),
    "report": ("injuries", f"""
SELECT *, season * 100 + week AS period,
       CAST(CASE trim(report_status) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.AVAILABILITY.items())} ELSE 1.0 END AS DOUBLE) AS availability
FROM injuries WHERE gsis_id IS NOT NULL"""),
    "listed_usage": ("report player_timeline", """
SELECT r.*, p.usage_post FROM report r ASOF LEFT JOIN player_timeline p
  ON p.player_id = r.gsis_id AND r.period > p.period"""),
    "absence": ("listed_usage team_timeline", """
SELECT c.season, c.week, c.team, c.period, c.missing, t.team_usage,
       least(greatest(coalesce(CASE WHEN t.team_usage > 0 THEN c.missing / t.team_usage END, 0), 0), 1) AS cost
FROM (SELECT season, week, team, period, sum((1.0 - availability) * coalesce(usage_post, 0)) AS missing
      FROM listed_usage GROUP BY season, week, team, period) c
ASOF LEFT JOIN team_timeline t ON t.team = c.team AND c.period > t.period"""),
    "gamelog": ("scored", f"""
SELECT *, greatest(prob_home, 1.0 - prob_home) AS game_confidence,
  {', '.join(f'''CASE WHEN {p} IS NULL THEN NULL WHEN home_win = 0.5 THEN 0.5 WHEN ({p} > 0.5) = (home_win = 1.0) THEN 1.0 ELSE 0.0 END AS hit_{n},
  pow({p} - home_win, 2) AS brier_{n}''' for n, p in (("blended", "prob_home"), ("model", "model_prob_home"), ("market", "market_prob_home"), ("elo", "elo_prob_home")))},
  pred_margin - market_spread AS spread_edge, abs(pred_margin - market_spread) AS abs_edge,
  CASE WHEN market_spread IS NULL THEN '' WHEN margin - market_spread = 0 THEN 'P'
       WHEN (pred_margin - market_spread > 0) = (margin - market_spread > 0) THEN 'W' ELSE 'L' END AS ats_result,
  {', '.join(f'abs(actual_total - {c}) AS err_total_{n}, actual_total - {c} AS signed_total_{n}' for n, c in (("blended", "pred_total"), ("model", "model_total"), ("market", "market_total")))},
  model_total - market_total AS ou_edge,
  CASE WHEN market_total IS NULL THEN '' WHEN actual_total - market_total = 0 THEN 'P'
       WHEN (model_total - market_total > 0) = (actual_total - market_total > 0) THEN 'W' ELSE 'L' END AS ou_result
FROM scored WHERE completed"""),
})


def record_sql(table: str, edge: str, gap: str, thresholds, where: str, pay: float = 100.0 / 110.0) -> str:
    """Win, loss and push counts at every threshold."""
    values = ", ".join(f"({float(t)})" for t in thresholds)
    return f"""
SELECT threshold, bets, wins, losses, pushes,
       wins * 1.0 / nullif(wins + losses, 0) AS win_rate,
       (wins * CAST({pay!r} AS DOUBLE) - losses) / nullif(wins + losses, 0) AS roi,
       wins * CAST({pay!r} AS DOUBLE) - losses AS units,
       1.0 / (1.0 + CAST({pay!r} AS DOUBLE)) AS breakeven
FROM (
  SELECT t.threshold, count(*) AS bets,
         count(*) FILTER (WHERE result > 0) AS wins, count(*) FILTER (WHERE result < 0) AS losses,
         count(*) FILTER (WHERE result = 0) AS pushes
  FROM (SELECT {edge} AS edge, CASE WHEN {edge} > 0 THEN {gap} ELSE -({gap}) END AS result FROM {table} WHERE {where}) r
  JOIN (VALUES {values}) t(threshold) ON abs(r.edge) >= t.threshold
  GROUP BY t.threshold)"""


def metrics_sql(table: str, prob: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    p = floored("p")
    return f"""
SELECT {lead}count(*) AS n, avg({hit(p)}) AS accuracy, avg(pow({p} - home_win, 2)) AS brier,
       -avg(home_win * ln({p}) + (1 - home_win) * ln(1 - {p})) AS log_loss,
       avg(greatest({p}, 1 - {p})) AS mean_prob
FROM (SELECT {lead}home_win, {prob} AS p FROM {table} WHERE home_win IS NOT NULL AND {prob} IS NOT NULL)
{'GROUP BY ' + by if by else ''}"""


def calibration_sql(table: str, prob: str, edges) -> str:
    p = floored(prob)
    bands = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"""
SELECT low, high, count(*) AS games, avg(c) AS predicted, avg(hit) AS actual, avg(hit) - avg(c) AS gap
FROM (SELECT greatest({p}, 1 - {p}) AS c, {hit(p)} AS hit FROM {table} WHERE home_win IS NOT NULL AND {prob} IS NOT NULL) s
JOIN (VALUES {bands}) b(i, low, high) ON (c > low OR (i = 0 AND c = low)) AND c <= high
GROUP BY low, high"""


def regression_sql(table: str, predicted: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}count(*) AS n, avg(abs(actual_total - {predicted})) AS mae,
       sqrt(avg(pow(actual_total - {predicted}, 2))) AS rmse,
       avg(actual_total - {predicted}) AS bias, avg({predicted}) AS mean_total
FROM {table} WHERE actual_total IS NOT NULL AND {predicted} IS NOT NULL {'GROUP BY ' + by if by else ''}"""


def scorecard_sql(table: str, select: str, group: str) -> str:
    p = floored("prob_home")
    return f"""
SELECT {select}, count(*) AS games, sum(hit) AS correct, avg(hit) AS accuracy,
       avg(pow({p} - home_win, 2)) AS brier,
       coalesce(sum(ats_win), 0) AS ats_wins, count(ats_win) AS ats_played,
       coalesce(sum(ou_win), 0) AS ou_wins, count(ou_win) AS ou_played,
       avg(total_error) AS total_mae, avg(abs(actual_total - market_total)) AS market_total_mae,
       coalesce(sum(ats_win), 0) / nullif(count(ats_win), 0) AS ats_rate,
       coalesce(sum(ou_win), 0) / nullif(count(ou_win), 0) AS ou_rate
FROM {table} GROUP BY {group}"""

_PW = "PARTITION BY player_id ORDER BY season, week, game_id, team, opponent_team"
_PLAYER = {"passing_yards": "form_pass_yards", "attempts": "form_attempts", "rushing_yards": "form_rush_yards",
           "carries": "form_carries", "receiving_yards": "form_rec_yards", "targets": "form_targets"}


def ratio(top: str, bottom: str, bounds) -> str:
    r = f"coalesce(CASE WHEN {bottom} >= {K.MIN_RATE_VOLUME} THEN {top} / {bottom} END, 0)"
    return f"least(greatest({r}, {bounds[0]}), {bounds[1]})"


SHARED_SQL.update({
    "passer_raw": ("player_weeks", """
SELECT player_id, game_id, season, week, team, attempts + sacks_suffered AS dropbacks, passing_cpoe AS cpoe,
       passing_epa / (attempts + sacks_suffered) AS epa
FROM player_weeks WHERE attempts + sacks_suffered >= 1"""),
    "passer_base": ("passer_raw", baseline("passer_raw", ["cpoe", "epa"])),
    "passer_centered": ("passer_raw passer_base", f"""
SELECT r.player_id, r.game_id, r.season, r.week, r.team, r.dropbacks, r.season * 100 + r.week AS period,
       (r.cpoe - b.cpoe) / {K.PASSER_CPOE_SCALE} AS cpoe, (r.epa - b.epa) / CAST({K.PASSER_EPA_SCALE} AS DOUBLE) AS epa
FROM passer_raw r JOIN passer_base b USING (season)"""),
    "passer_lists": ("passer_centered", """
SELECT *, sum(dropbacks) OVER (w ROWS UNBOUNDED PRECEDING) AS seen_post,
       list(cpoe) FILTER (WHERE cpoe IS NOT NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS lc,
       list(epa) FILTER (WHERE epa IS NOT NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS le
FROM passer_centered WINDOW w AS (PARTITION BY player_id ORDER BY season, week, game_id, team)"""),
    "passer_states": ("passer_lists", f"""
SELECT *, CASE WHEN sc IS NULL THEN se WHEN se IS NULL THEN sc ELSE (sc + se) / 2.0 END
          * (seen_post / (seen_post + {K.PASSER_SHRINK_DROPBACKS})) AS qb_rating_post
FROM (SELECT player_id, game_id, season, week, team, period, dropbacks, seen_post,
             CASE WHEN len(lc) > 0 THEN list_reduce(lc, lambda s, v: s + {K.PASSER_ALPHA} * (v - s)) END AS sc,
             CASE WHEN len(le) > 0 THEN list_reduce(le, lambda s, v: s + {K.PASSER_ALPHA} * (v - s)) END AS se
      FROM passer_lists)"""),
    "passer_ratings": ("passer_states", """
SELECT *, lag(qb_rating_post) OVER (PARTITION BY player_id ORDER BY season, week, game_id, team) AS qb_rating_pre,
       seen_post - dropbacks AS qb_dropbacks_pre FROM passer_states"""),
    "passer_timeline": ("passer_ratings", """
SELECT player_id, period, qb_rating_post FROM passer_ratings
QUALIFY row_number() OVER (PARTITION BY player_id, period ORDER BY game_id DESC, team DESC) = 1"""),
    "listed": ("games", """
SELECT game_id, season, week, kickoff, home_team AS team, home_qb_id AS player_id, TRUE AS is_home, season * 100 + week AS period FROM games
UNION ALL
SELECT game_id, season, week, kickoff, away_team, away_qb_id, FALSE, season * 100 + week FROM games"""),
    "starters": ("listed passer_timeline", """
SELECT l.*, t.qb_rating_post AS qb_rating_pre FROM listed l ASOF LEFT JOIN passer_timeline t
  ON t.player_id = l.player_id AND l.period > t.period"""),
    "starter_base": ("starters", f"""
SELECT *, {ewma_prior('qb_rating_pre', K.PASSER_TEAM_ALPHA, 'PARTITION BY team ORDER BY season, week, kickoff, game_id, is_home')} AS team_qb_baseline
FROM starters"""),
    "passer_terms": ("starter_base", """
SELECT game_id, sum(CASE WHEN is_home THEN 1.0 ELSE -1.0 END * coalesce(qb_rating_pre - team_qb_baseline, 0)) AS qb_delta,
       sum(CASE WHEN is_home THEN 1.0 ELSE -1.0 END * coalesce(qb_rating_pre, 0)) AS qb_edge
FROM starter_base GROUP BY game_id"""),
    "availability_terms": ("games absence", """
SELECT g.game_id, CASE WHEN g.season IN (SELECT season FROM injuries)
       THEN coalesce(a.cost, 0) - coalesce(h.cost, 0) ELSE 0 END AS availability_edge
FROM games g
LEFT JOIN absence h ON h.season = g.season AND h.week = g.week AND h.team = g.home_team
LEFT JOIN absence a ON a.season = g.season AND a.week = g.week AND a.team = g.away_team"""),
    "player_rolled": ("player_weeks", f"""
SELECT *, CAST(row_number() OVER ({_PW}) - 1 AS DOUBLE) AS form_games,
       {', '.join(mean_prior(c, K.PLAYER_ALPHA, _PW) + f' AS {f}' for c, f in _PLAYER.items())}
FROM player_weeks"""),
    "player_rates": ("player_rolled", f"""
SELECT *, {ratio('form_pass_yards', 'form_attempts', K.RATE_BOUNDS['form_pass_ypa'])} AS form_pass_ypa,
       {ratio('form_rush_yards', 'form_carries', K.RATE_BOUNDS['form_rush_ypc'])} AS form_rush_ypc,
       {ratio('form_rec_yards', 'form_targets', K.RATE_BOUNDS['form_rec_ypt'])} AS form_rec_ypt
FROM player_rolled"""),
    "allowed": ("player_weeks", """
SELECT opponent_team AS team, season, week, coalesce(sum(passing_yards), 0) AS pass_yards_allowed,
       coalesce(sum(rushing_yards), 0) AS rush_yards_allowed FROM player_weeks GROUP BY opponent_team, season, week"""),
    "allowed_form": ("allowed", f"""
SELECT team, season, week,
       {', '.join(mean_prior(c, K.PLAYER_ALPHA, 'PARTITION BY team ORDER BY season, week') + f' AS opp_{c}'
                  for c in ('pass_yards_allowed', 'rush_yards_allowed'))} FROM allowed"""),
    "one_listing": ("report", """
SELECT season, week, gsis_id AS player_id, report_status, availability FROM report
QUALIFY row_number() OVER (PARTITION BY season, week, gsis_id ORDER BY team, coalesce(trim(report_status), '')) = 1"""),
    "hfa": ("games", f"""
SELECT s.league, s.season, CASE WHEN s.season IN (SELECT unnest({list(K.HFA_OVERRIDES)})) THEN {K.HFA_OVERRIDES[2020]}
       WHEN sum(p.n) >= {K.HFA_MIN_GAMES} AND sum(CASE WHEN p.season <> 2020 THEN p.n END) >= {K.HFA_MIN_GAMES}
       THEN least(greatest(sum(CASE WHEN p.season <> 2020 THEN p.t END) / sum(CASE WHEN p.season <> 2020 THEN p.n END), {K.HFA_MIN}), {K.HFA_MAX})
       ELSE {K.HFA_DEFAULT} END AS hfa
FROM (SELECT DISTINCT league, season FROM games) s
LEFT JOIN (SELECT league, season, count(*) AS n, sum(margin) AS t FROM games
           WHERE completed AND NOT neutral AND NOT is_playoff GROUP BY league, season) p
  ON p.league = s.league AND p.season < s.season AND p.season >= s.season - {K.HFA_SEASONS}
GROUP BY s.league, s.season"""),
    "rating_order": ("games hfa", f"""
SELECT g.league, g.season, g.game_id, g.home_team, g.away_team, CASE WHEN g.neutral THEN 0.0 ELSE h.hfa END AS hfa,
       CASE WHEN g.home_rest - g.away_rest IS NULL THEN 0.0
            ELSE least(greatest(g.home_rest - g.away_rest, -{K.REST_CAP_DAYS}), {K.REST_CAP_DAYS}) END * {K.REST_POINTS_PER_DAY} AS rest,
       CASE WHEN g.completed THEN g.margin END AS margin,
       row_number() OVER (PARTITION BY g.league ORDER BY g.season, g.week, g.kickoff, g.game_id) AS n
FROM games g LEFT JOIN hfa h ON h.league = g.league AND h.season = g.season"""),
    "rating_walk": ("rating_order", f"""
SELECT league, 'team', team, 0::BIGINT, {K.ELO_INIT}::DOUBLE, min(season), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
FROM (SELECT league, home_team AS team, season FROM rating_order UNION ALL SELECT league, away_team, season FROM rating_order)
GROUP BY league, team
UNION
(WITH now AS (
  SELECT o.*, {K.ELO_INIT} + pow({K.ELO_SEASON_CARRY}, o.season - h.season) * (h.elo - {K.ELO_INIT}) AS he,
         {K.ELO_INIT} + pow({K.ELO_SEASON_CARRY}, o.season - a.season) * (a.elo - {K.ELO_INIT}) AS ae
  FROM (SELECT DISTINCT league, n + 1 AS n FROM rating_walk) w
  JOIN rating_order o ON o.league = w.league AND o.n = w.n
  JOIN recurring.rating_walk h ON h.league = o.league AND h.kind = 'team' AND h.id = o.home_team
  JOIN recurring.rating_walk a ON a.league = o.league AND a.kind = 'team' AND a.id = o.away_team
), told AS (SELECT *, he - ae + (hfa + rest) * {K.ELO_PER_POINT} AS diff FROM now),
taught AS (
  SELECT *, CASE WHEN margin IS NULL THEN 0.0 ELSE {K.ELO_K}
    * CASE WHEN margin = 0 THEN 1.0 ELSE ln(abs(margin) + 1) * {K.ELO_MOV_B} / (sign(margin) * diff * 0.001 + {K.ELO_MOV_B}) END
    * ((sign(margin) + 1) / 2.0 - 1.0 / (1.0 + pow(10.0, -diff / {K.ELO_DIVISOR}))) END AS shift FROM told
)
SELECT league, 'team', home_team, n, he + shift, season, NULL, NULL, NULL FROM taught
UNION ALL SELECT league, 'team', away_team, n, ae - shift, season, NULL, NULL, NULL FROM taught
UNION ALL SELECT league, 'game', CAST(game_id AS VARCHAR), n, NULL, season, he, ae, diff FROM taught)""",
        "(league, kind, id, n, elo, season, elo_home_pre, elo_away_pre, elo_diff) USING KEY (league, kind, id)"),
    "rated": ("rating_walk rating_order", f"""
SELECT o.game_id, w.elo_home_pre, w.elo_away_pre, w.elo_diff, w.elo_home_pre - w.elo_away_pre AS elo_raw_diff,
       o.hfa AS elo_hfa_points, o.rest AS elo_rest_points, 0.0 AS elo_qb_points,
       1.0 / (1.0 + pow(10.0, -w.elo_diff / {K.ELO_DIVISOR})) AS elo_prob_home, w.elo_diff / {K.ELO_PER_POINT} AS elo_spread
FROM rating_order o JOIN rating_walk w ON w.league = o.league AND w.kind = 'game' AND w.id = CAST(o.game_id AS VARCHAR)"""),
    "final_ratings": ("rating_walk rating_order", f"""
SELECT w.league, w.id AS team, e.elo, (e.elo - {K.ELO_INIT}) / {K.ELO_PER_POINT} AS spread_vs_average
FROM rating_walk w JOIN (SELECT league, max(season) AS season FROM rating_order GROUP BY league) s USING (league),
     LATERAL (SELECT {K.ELO_INIT} + pow({K.ELO_SEASON_CARRY}, s.season - w.season) * (w.elo - {K.ELO_INIT}) AS elo) e
WHERE w.kind = 'team'"""),
    "team_table": ("sides_long", f"""
SELECT team, league, count(*) AS games, avg(points_for) AS points_for, avg(points_against) AS points_against
FROM (SELECT * FROM sides_long WHERE points_for IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY team ORDER BY season DESC, week DESC, kickoff DESC, game_id DESC) <= {K.TEAM_TABLE_GAMES})
GROUP BY team, league"""),
    # a rating with an exact SQL form, standing in for the sequential one
    "stand_in_elo": ("sides_long", """
SELECT team, 1500 + 10 * avg(points_for - points_against) AS elo,
       10 * avg(points_for - points_against) / 25.0 AS spread_vs_average
FROM sides_long WHERE points_for IS NOT NULL GROUP BY team"""),
    "halves_fit": ("scored", """
SELECT count(*) AS n_train, count(*) >= 200 AS fitted_from_history,
       CASE WHEN count(*) >= 200 THEN regr_slope(first_half_total, pred_total) ELSE 0.504 END AS total_slope,
       CASE WHEN count(*) >= 200 THEN regr_intercept(first_half_total, pred_total) ELSE 0 END AS total_intercept,
       CASE WHEN count(*) >= 200 THEN regr_slope(first_half_margin, pred_margin) ELSE 0.554 END AS margin_slope,
       CASE WHEN count(*) >= 200 THEN regr_intercept(first_half_margin, pred_margin) ELSE 0 END AS margin_intercept
FROM scored WHERE first_half_total IS NOT NULL"""),
    "halved": ("scored halves_fit", """
SELECT *, total_slope * pred_total + total_intercept AS first_half_total_pred,
       margin_slope * pred_margin + margin_intercept AS first_half_margin_pred,
       (pred_total + pred_margin) / 2.0 AS home_team_total, (pred_total - pred_margin) / 2.0 AS away_team_total
FROM scored, halves_fit"""),
})


def conviction_sql(edge: str) -> str:
    return label(f"abs({edge})", K.CONVICTION_TIERS)


def band_case(value: str, bands, index: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {b[0]} THEN {b[index]}" for b in bands) + f" ELSE {bands[-1][index]} END"


def edge_prob(edge: str, fit) -> str:
    return f"least(1.0 / (1.0 + exp(-(CAST({fit[0]} AS DOUBLE) + {fit[1]} * abs({edge})))), CAST({K.BREAKEVEN} AS DOUBLE))"


_READABLE = tuple((b, "COIN FLIP" if t == "COINFLIP" else t) for b, t in K.CONFIDENCE_TIERS)
_FLAT = payout("-110.0")

SHARED_SQL["picks"] = ("edges", f"""
SELECT *, row_number() OVER (PARTITION BY season, week, market ORDER BY round(strength, 9) DESC, game_id) AS rank FROM (
SELECT game_id, season, week, away_team || ' @ ' || home_team AS game, 'Moneyline' AS market, pick_prob AS strength, pick,
       CAST(NULL AS DOUBLE) AS model, CAST(NULL AS DOUBLE) AS line, CAST(NULL AS DOUBLE) AS edge, pick_prob AS win_prob,
       {label('pick_prob', _READABLE)} AS rating, {band_case('pick_prob', K.CALIBRATION_BANDS, 1)} AS band_games,
       {band_case('pick_prob', K.CALIBRATION_BANDS, 2)} AS band_rate,
       pick_prob * {payout('pick_odds')} - (1.0 - pick_prob) AS ev FROM edges
UNION ALL
SELECT game_id, season, week, away_team || ' @ ' || home_team, 'Spread', abs(e),
       CASE WHEN e > 0 THEN home_team ELSE away_team END || ' ' || printf('%+.1f', CASE WHEN e > 0 THEN -market_spread ELSE market_spread END),
       model_margin, market_spread, e, {edge_prob('e', K.ATS_EDGE_FIT)}, {conviction_sql('e')},
       {band_case('abs(e)', K.ATS_BANDS, 1)}, {band_case('abs(e)', K.ATS_BANDS, 2)},
       {edge_prob('e', K.ATS_EDGE_FIT)} * {_FLAT} - (1.0 - {edge_prob('e', K.ATS_EDGE_FIT)})
FROM (SELECT *, model_margin - market_spread AS e FROM edges) WHERE e IS NOT NULL
UNION ALL
SELECT game_id, season, week, away_team || ' @ ' || home_team, 'Total', abs(e),
       CASE WHEN e > 0 THEN 'Over ' ELSE 'Under ' END || printf('%.1f', market_total),
       model_total, market_total, e, {edge_prob('e', K.OU_EDGE_FIT)}, {conviction_sql('e')},
       {band_case('abs(e)', K.OU_BANDS, 1)}, {band_case('abs(e)', K.OU_BANDS, 2)},
       {edge_prob('e', K.OU_EDGE_FIT)} * {_FLAT} - (1.0 - {edge_prob('e', K.OU_EDGE_FIT)})
FROM (SELECT *, model_total - market_total AS e FROM edges) WHERE e IS NOT NULL)""")
