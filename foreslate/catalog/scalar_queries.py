"""F-rows: scalar functions over the whole contest table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..functions.normal import INV_A, INV_B, INV_C, INV_D, INV_E, INV_F
from . import frames as R
from .registry import query
from .shared_sql import (
    clip, conviction_sql, edge_prob, fair, horner, implied, label, logit, payout, phi,
)


def scalar(key: str, spark: Callable[[], dict[str, Column]], sql: dict[str, str], ints: str = "",
           texts: str = "", view: str = "scored"):
    """One output row per contest with the named expressions."""
    floats = [c for c in sql if c not in ints.split() and c not in texts.split()]
    body = f"SELECT game_id, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {view}"

    @query(key, floats=" ".join(floats), ints=f"game_id {ints}", views=view, sql=body)
    def _(fx):
        source = R.priced(fx) if view == "priced" else R.scored(fx) if view == "scored" else fx.games
        return source.select("game_id", *[c.alias(n) for n, c in spark().items()])


def noise() -> Column:
    return F.col("noise")


scalar("f1_rating_to_prob", lambda: {"prob": S.elo_to_prob(noise() * 40)},
       {"prob": "1.0 / (1.0 + pow(10.0, -(noise * 40) / 400.0))"})
scalar("f2_rating_to_spread", lambda: {"spread": S.elo_to_spread(noise() * 40)}, {"spread": "noise * 40 / 25.0"})
scalar("f3_mov_multiplier", lambda: {"mult": S.mov_multiplier(F.col("margin"), noise() * 40)},
       {"mult": "CASE WHEN margin = 0 THEN 1.0 ELSE ln(abs(margin) + 1.0) * (2.2 / (noise * 40 * 0.001 + 2.2)) END"})
scalar("f4_spread_to_prob", lambda: {"prob": S.spread_to_prob(F.col("model_margin"))},
       {"prob": phi("(model_margin / 13.2)")})

_P = clip("prob_home", "CAST(1e-6 AS DOUBLE)", "CAST(0.999999 AS DOUBLE)")
_CENTRAL = f"(q * {horner('(0.180625 - q * q)', INV_A)} / {horner('(0.180625 - q * q)', INV_B)})"
_TAIL = (f"(CASE WHEN t <= 5 THEN {horner('(t - 1.6)', INV_C)} / {horner('(t - 1.6)', INV_D)} "
         f"ELSE {horner('(t - 5.0)', INV_E)} / {horner('(t - 5.0)', INV_F)} END)")


@query("f5_prob_to_spread", floats="spread", ints="game_id", views="scored", sql=f"""
SELECT game_id, 13.2 * CASE WHEN abs(q) <= 0.425 THEN {_CENTRAL} WHEN q < 0 THEN -{_TAIL} ELSE {_TAIL} END AS spread
FROM (SELECT game_id, {_P} - 0.5 AS q, sqrt(-ln(CASE WHEN {_P} - 0.5 < 0 THEN {_P} ELSE 1.0 - {_P} END)) AS t FROM scored)""")
def _(fx):
    return R.scored(fx).select("game_id", S.prob_to_spread(F.col("prob_home")).alias("spread"))


scalar("f6_logit_expit", lambda: {"log_odds": S.safe_logit(F.col("prob_home")), "back": S.expit(S.safe_logit(F.col("prob_home")))},
       {"log_odds": logit("prob_home"), "back": f"1.0 / (1.0 + exp(-({logit('prob_home')})))"})
scalar("f7_devig", lambda: {"prob": S.devig_moneyline(F.col("home_moneyline"), F.col("away_moneyline"))},
       {"prob": f"{implied('home_moneyline')} / ({implied('home_moneyline')} + {implied('away_moneyline')})"}, view="games")
scalar("f8_american_to_decimal", lambda: {"payout": S.american_to_decimal(F.col("home_moneyline"))},
       {"payout": payout("home_moneyline")}, view="games")
scalar("f9_prob_to_american", lambda: {"home": S.prob_to_american(F.col("prob_home")), "away": S.prob_to_american(1.0 - F.col("prob_home"))},
       {"home": fair("prob_home"), "away": fair("(1.0 - prob_home)")})
scalar("f10_american_to_prob", lambda: {"prob": S.american_to_prob(F.col("away_moneyline"))},
       {"prob": implied("away_moneyline")}, view="games")
scalar("f11_expected_value", lambda: {"ev": S.expected_value(F.col("prob_home"), F.col("home_moneyline"))},
       {"ev": f"prob_home * {payout('home_moneyline')} - (1.0 - prob_home)"})
scalar("f12_kelly", lambda: {"stake": S.kelly_fraction(F.col("model_prob_home"), F.col("home_moneyline"))},
       {"stake": f"greatest(coalesce((model_prob_home * {payout('home_moneyline')} - (1.0 - model_prob_home)) / {payout('home_moneyline')} * 0.25, 0.0), 0.0)"})
scalar("f13_confidence_tier",
       lambda: {"tier": S.confidence_tier(F.col("market_prob_home")), "readable": S.readable_tier(F.col("prob_home"))},
       {"tier": label("(CASE WHEN market_prob_home IS NOT NULL THEN greatest(market_prob_home, 1.0 - market_prob_home) END)", K.CONFIDENCE_TIERS, "'UNKNOWN'"),
        "readable": label("greatest(prob_home, 1.0 - prob_home)", tuple((b, "COIN FLIP" if t == "COINFLIP" else t) for b, t in K.CONFIDENCE_TIERS))},
       texts="tier readable")
_NEED = "(CASE WHEN market_total % 1.0 = 0 THEN market_total + 0.5 ELSE market_total END)"
scalar("f14_over_probability", lambda: {"over": S.over_probability(F.col("model_total"), F.col("market_total"))},
       {"over": f"CASE WHEN market_total IS NOT NULL THEN 1.0 - {phi(f'(({_NEED} - model_total) / 13.3)')} END"})
scalar("f15_push_probability", lambda: {"push": S.push_probability(F.col("model_total"), F.col("market_total"))},
       {"push": f"CASE WHEN market_total % 1.0 = 0 THEN {phi('((market_total + 0.5 - model_total) / 13.3)')} - {phi('((market_total - 0.5 - model_total) / 13.3)')} ELSE 0.0 END"})
scalar("f16_team_totals",
       lambda: dict(zip(("home", "away"), S.team_totals(F.col("pred_total"), F.col("pred_margin")))),
       {"home": "(pred_total + pred_margin) / 2.0", "away": "(pred_total - pred_margin) / 2.0"})
scalar("f17_actual_total", lambda: {"total": S.actual_total(F.col("home_score"), F.col("away_score"))},
       {"total": "home_score + away_score"}, view="games")
_EDGE = "(model_total - market_total)"
scalar("f18_edge_probability",
       lambda: {"win": F.when(F.col("market_total").isNotNull(), S.edge_probability(F.col("model_total") - F.col("market_total"), K.OU_EDGE_FIT))},
       {"win": f"CASE WHEN market_total IS NOT NULL THEN {edge_prob(_EDGE, K.OU_EDGE_FIT)} END"})
scalar("f19_conviction", lambda: {"word": S.conviction(F.col("model_total") - F.col("market_total"))},
       {"word": conviction_sql(_EDGE)}, texts="word")
scalar("f20_outcomes", lambda: {
    "winner": S.winner_outcome(F.col("prob_home"), F.col("margin")),
    "total": S.total_outcome(F.col("ou_pick"), F.col("actual_total"), F.col("market_total")),
    "word": S.grade_word(F.col("home_win")),
}, {
    "winner": "CASE WHEN margin IS NULL THEN '' WHEN margin = 0 THEN 'PUSH' WHEN (prob_home >= 0.5) = (margin > 0) THEN 'HIT' ELSE 'MISS' END",
    "total": "CASE WHEN actual_total IS NULL OR market_total IS NULL THEN '' WHEN actual_total = market_total THEN 'PUSH' WHEN (actual_total > market_total) = (ou_pick = 'OVER') THEN 'HIT' ELSE 'MISS' END",
    "word": "CASE WHEN home_win IS NULL THEN '' WHEN home_win = 1 THEN 'WON' WHEN home_win = 0 THEN 'LOST' ELSE 'PUSH' END",
}, texts="winner total word", view="priced")
scalar("f21_period", lambda: {"period": S.period(F.col("season"), F.col("week"))}, {"period": "season * 100 + week"},
       ints="period", view="games")
scalar("f22_picked_side_probability", lambda: {"quoted": S.picked_side_probability(F.col("prob_home"), F.col("market_prob_home"))},
       {"quoted": "CASE WHEN prob_home >= 0.5 THEN market_prob_home ELSE 1.0 - market_prob_home END"})
scalar("f23_spread_ticket",
       lambda: {"ticket": S.spread_ticket(F.col("model_margin") - F.col("market_spread"), F.col("market_spread"), F.col("home_team"), F.col("away_team"))},
       {"ticket": "CASE WHEN market_spread IS NOT NULL THEN CASE WHEN model_margin - market_spread > 0 THEN home_team ELSE away_team END || ' ' || printf('%+.1f', CASE WHEN model_margin - market_spread > 0 THEN -market_spread ELSE market_spread END) END"},
       texts="ticket")
