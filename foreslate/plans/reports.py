"""Report tables, each a DataFrame.

Slate tables take any number of slates at once; ranks and headlines are per
(season, week), so a slate is the unit of every window here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import grading as G
from ..operators.ranks import place_in_group
from ..operators.scans import prior_baseline

SLATE = ("season", "week")


def against_long_run(card: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scorecard measures beside the fixed long-run figures."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("measure"), F.col(column).alias("this_season"),
                 F.lit(value).alias("long_run"))
        for label, column, value in K.LONG_RUN
    ])
    return card.select(*by, F.explode(rows).alias("m")).select(*by, "m.*")


def slate_headline(slate: DataFrame) -> DataFrame:
    """Best pick, coin-flip count and highest total of every slate, one aggregation."""
    first = -F.col("game_id")
    loser = F.when(F.col("pick") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    return slate.groupBy(*SLATE).agg(
        F.count("*").alias("games"),
        F.count_if(F.col("pick_prob") < K.COINFLIP_BELOW).alias("coinflips"),
        F.max_by(F.concat("pick", F.lit(" over "), loser), F.struct(F.round("pick_prob", 9), first)).alias("best_pick"),
        F.max("pick_prob").alias("pick_prob"),
        F.max_by(matchup(), F.struct(F.round("pred_total", 9), first)).alias("highest_total"),
        F.max("pred_total").alias("pred_total"),
    )


def matchup() -> Column:
    return F.concat("away_team", F.lit(" @ "), "home_team")


def history_note(history: DataFrame) -> DataFrame:
    """Rows and week span of each season a fit has seen."""
    return history.where("completed").groupBy("season").agg(
        F.count("*").alias("games"), F.min("week").alias("first_week"), F.max("week").alias("last_week"))


def last_settled_week(graded: DataFrame) -> DataFrame:
    """Rows of each season's latest graded week."""
    last = graded.groupBy("season").agg(F.max("week").alias("week"))
    return graded.join(last, ["season", "week"], "left_semi")


def naive_comparison(rows: DataFrame, actual: str, predicted: str, own: str | None = None) -> DataFrame:
    """Error of a forecast beside that of the earlier seasons' mean, per season.

    ``own`` names the entity's own form, if its error is asked for too.
    """
    form = {} if own is None else {"own_mae": F.avg(F.abs(F.col(actual) - F.col(own)))}
    base = prior_baseline(rows, [actual]).withColumnRenamed(actual, "__mean")
    return rows.join(base, "season").groupBy("season").agg(
        F.count("*").alias("games"),
        F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("model_mae"),
        F.avg(F.abs(F.col(actual) - F.col("__mean"))).alias("mean_mae"),
        *[error.alias(name) for name, error in form.items()],
    )


# --- backtest tables -------------------------------------------------------


def method_summary(log: DataFrame) -> DataFrame:
    """Games, accuracy and Brier per method from graded columns, plus always-home."""
    long = log.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("method"), F.col(f"hit_{n}").alias("hit"), F.col(f"brier_{n}").alias("b"))
        for n, _ in G.WINNER_METHODS
    ], F.struct(F.lit("home_team_always").alias("method"), F.col("home_win").alias("hit"),
                F.lit(None).cast("double").alias("b")))).alias("m"))
    return long.select("m.*").groupBy("method").agg(
        F.count("hit").alias("games"), F.avg("hit").alias("accuracy"), F.avg("b").alias("brier"))


def band_table(spark, edges: Sequence[float]) -> DataFrame:
    bands = F.array(*[
        F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high")) for lo, hi in zip(edges, edges[1:])
    ])
    return spark.range(1).select(F.explode(bands).alias("b")).select("b.*")


def calibration_bands(log: DataFrame, edges: Sequence[float] = K.CALIBRATION_EDGES) -> DataFrame:
    """(lo, hi] bands, empty ones kept; a confidence of exactly .5 falls outside.

    Rows are reduced to one line per band before they meet the band table.
    """
    c = F.col("confidence")
    low = None
    for lo, hi in zip(edges, edges[1:]):
        inside = (c > lo) & (c <= hi)
        low = F.when(inside, lo) if low is None else low.when(inside, lo)
    filled = log.withColumn("low", low).where(F.col("low").isNotNull()).groupBy("low").agg(
        F.count("*").alias("games"), F.avg(c).alias("said"), F.avg("hit_blended").alias("actual"))
    out = band_table(log.sparkSession, edges).join(filled, "low", "left")
    return out.withColumns({
        "games": F.coalesce("games", F.lit(0)), "gap": F.col("actual") - F.col("said")})


def spread_ladder(log: DataFrame, odds: int = K.VIG_ODDS, thresholds=K.ATS_THRESHOLDS) -> DataFrame:
    return G.spread_record(log, thresholds=thresholds, odds=odds)


def totals_backtest(log: DataFrame) -> DataFrame:
    """Errors per method and the over/under ladder, stacked with a section name."""
    errors = log.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"err_total_{n}").alias("e"),
                 F.col(f"signed_total_{n}").alias("s")) for n, _ in G.TOTAL_METHODS
    ])).alias("m")).select("m.*").groupBy("name").agg(
        F.count("e").alias("games"), F.avg("e").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("s").alias("bias"),
    ).withColumn("section", F.lit("error"))
    ladder = G.total_record(log).select(
        F.lit("record").alias("section"), F.format_string("%.1f", "threshold").alias("name"),
        F.col("bets").alias("games"), "wins", "losses", "pushes", "win_rate", "roi")
    return errors.unionByName(ladder, allowMissingColumns=True)


# --- slate tables ----------------------------------------------------------


def slate_table(slate: DataFrame) -> DataFrame:
    """Pick, confidence, own and market numbers, outcome and value per game."""
    p = F.col("prob_home")
    return slate.select(
        "game_id", *SLATE, "away_team", "home_team", "pick", "pick_prob", "confidence",
        F.col("pred_margin").alias("model"), F.col("market_spread").alias("line"),
        F.col("spread_edge").alias("edge"),
        S.picked_side_probability(p, F.col("market_prob_home")).alias("market_prob"),
        S.winner_outcome(p, F.col("margin")).alias("outcome"),
        S.prob_to_american(F.col("pick_prob")).alias("fair_ml"),
        F.col("pick_odds").alias("book_ml"),
        S.expected_value(F.col("pick_prob"), F.col("pick_odds")).alias("ev"),
        F.col("disagrees_with_market"),
    )


def totals_table(slate: DataFrame) -> DataFrame:
    over = F.col("prob_over")
    sided = F.when(F.col("ou_pick") == "OVER", over).otherwise(1.0 - over)
    return slate.select(
        "game_id", *SLATE, "away_team", "home_team", F.col("ou_pick").alias("pick"),
        F.col("model_total").alias("model"), F.col("market_total").alias("line"),
        F.col("pred_total").alias("projection"), F.col("model_edge").alias("edge"),
        "prob_over", "prob_push",
        S.band_label(sided, K.CONFIDENCE_TIERS, "-").alias("confidence"),
        S.total_outcome(F.col("ou_pick"), F.col("actual_total"), F.col("market_total")).alias("outcome"),
    )


def splits_table(slate: DataFrame) -> DataFrame:
    return slate.select(
        "game_id", *SLATE, "away_team", "home_team", "away_team_total", "home_team_total", "pred_total",
        "first_half_total_pred", "first_half_margin_pred", "second_half_total_pred", "second_half_margin_pred")


def spread_table(slate: DataFrame) -> DataFrame:
    """The model's number against the posted one, and the side it prefers."""
    edge = F.col("pred_margin") - F.col("market_spread")
    side = F.when(edge.isNull(), "-").when(edge > 0, F.col("home_team")).otherwise(F.col("away_team"))
    return slate.select(
        "game_id", *SLATE, "away_team", "home_team", F.col("market_spread").alias("line"),
        F.col("pred_margin").alias("model"), edge.alias("edge"), side.alias("model_likes"))


def last_week_table(graded: DataFrame) -> DataFrame:
    """Latest settled slate, graded on all three markets."""
    total = S.grade_word(F.col("ou_win"))
    return last_settled_week(graded).select(
        "game_id", *SLATE, "away_team", "home_team",
        F.concat(F.format_string("%.0f", "away_score"), F.lit("-"), F.format_string("%.0f", "home_score")).alias("score"),
        "pick", S.grade_word(F.col("hit")).alias("won"),
        F.col("market_spread").alias("spread"), S.grade_word(F.col("ats_win")).alias("covered"),
        F.col("market_total").alias("total"),
        F.when(total == "", "").otherwise(
            F.concat(F.initcap("ou_pick"), F.lit(" — "), F.lower(total))).alias("over_under"),
    )


def user_pick_table(slate: DataFrame, picks: DataFrame) -> DataFrame:
    """The reader's own pick (game_id, user_pick) graded beside the model's."""
    margin, mine = F.col("margin"), F.col("user_pick")
    right = ((mine == F.col("home_team")) & (margin > 0)) | ((mine == F.col("away_team")) & (margin < 0))
    return slate.join(picks, "game_id", "left").select(
        "game_id", *SLATE, "pick", S.winner_outcome(F.col("prob_home"), margin).alias("outcome"),
        "user_pick",
        F.when(mine.isNull() | margin.isNull(), "").when(margin == 0, "PUSH")
        .when(right, "HIT").otherwise("MISS").alias("user_outcome"),
    )


# --- ranked picks ----------------------------------------------------------


def band_lookup(value: Column, bands) -> tuple[Column, Column]:
    """Sample and rate of the first band at or below ``value``; the last one otherwise."""
    sample = rate = None
    for lower, n, r in bands:
        sample = F.when(value >= lower, n) if sample is None else sample.when(value >= lower, n)
        rate = F.when(value >= lower, r) if rate is None else rate.when(value >= lower, r)
    return sample.otherwise(bands[-1][1]), rate.otherwise(bands[-1][2])


def ranked_picks(slate: DataFrame) -> DataFrame:
    """Every pick of every slate in three markets, ranked inside its market.

    Outright picks carry their own probability; spread and total picks are
    rated by how far the unblended number sits from the line.  One scan makes
    all three rows of a game.
    """
    p, none = F.col("prob_home"), F.lit(None).cast("double")
    conf = F.greatest(p, 1.0 - p)

    def row(market, strength, pick, model, line, edge, win, rating, band, ev) -> Column:
        return F.struct(
            F.lit(market).alias("market"), strength.alias("strength"), pick.alias("pick"),
            model.alias("model"), line.alias("line"), edge.alias("edge"), win.alias("win_prob"),
            rating.alias("rating"), band[0].alias("band_games"), band[1].alias("band_rate"), ev.alias("ev"))

    money = row("Moneyline", conf, F.when(p >= 0.5, F.col("home_team")).otherwise(F.col("away_team")),
                none, none, none, conf, S.readable_tier(p), band_lookup(conf, K.CALIBRATION_BANDS),
                S.expected_value(conf, F.col("pick_odds")))

    def edged(market, model, line, fit, bands, pick) -> Column:
        edge = model - line
        win = S.edge_probability(edge, fit)
        return F.when(edge.isNotNull(), row(
            market, F.abs(edge), pick(edge), model, line, edge, win, S.conviction(edge),
            band_lookup(F.abs(edge), bands), S.expected_value(win, F.lit(float(K.VIG_ODDS)))))

    spread, total = F.col("market_spread"), F.col("market_total")
    sided = edged("Spread", F.col("model_margin"), spread, K.ATS_EDGE_FIT, K.ATS_BANDS,
                  lambda e: S.spread_ticket(e, spread, F.col("home_team"), F.col("away_team")))
    over = edged("Total", F.col("model_total"), total, K.OU_EDGE_FIT, K.OU_BANDS,
                 lambda e: F.concat(F.when(e > 0, "Over ").otherwise("Under "), F.format_string("%.1f", total)))
    picks = slate.select(
        "game_id", *SLATE, matchup().alias("game"),
        F.explode(F.array_compact(F.array(money, sided, over))).alias("m"),
    ).select("game_id", *SLATE, "game", "m.*")
    # strengths equal but for the last bits of a logarithm are ties
    return place_in_group(picks, [*SLATE, "market"], [(F.round("strength", 9), True), ("game_id", False)], "rank")


# --- players, ratings, pairs ----------------------------------------------


def player_table(projections: DataFrame, top: int, identity: Sequence[str] = ("player_id", "team", "availability")) -> DataFrame:
    from ..operators.reshape import top_per_category

    categories = [f"proj_{t}" for t in K.PLAYER_TARGETS]
    ranked = top_per_category(projections, categories, top, identity, ["player_id", "team"])
    listed = F.format_string("listed (%.0f%%)", F.col("availability") * 100)
    return ranked.withColumn("status", F.when(F.col("availability") >= 0.999, "available").otherwise(listed))


def ratings_table(ratings: DataFrame) -> DataFrame:
    """Ratings ranked inside their league, with their worth in points."""
    order = W.partitionBy("league").orderBy(F.desc("elo"), "team")
    return ratings.withColumn("rank", F.row_number().over(order))


def team_data(table: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    return table if ratings is None else table.join(ratings, "team", "left")


def pair_projection(pairs: DataFrame, teams: DataFrame, hfa: float = K.HFA_DEFAULT) -> DataFrame:
    """Asked-for pairs (home_team, away_team, neutral): spread, chances, prices, totals.

    Two key joins onto the team table; any two teams may be asked for.
    """
    columns = ("elo", "points_for", "points_against")
    for side in ("home", "away"):
        pairs = pairs.join(teams.select(
            F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
        ), f"{side}_team", "left")
    edge = F.when(F.col("neutral"), F.lit(0.0)).otherwise(F.lit(float(hfa)))
    spread = (F.col("home_elo") - F.col("away_elo")) / K.ELO_PER_POINT + edge
    total = (F.col("home_points_for") + F.col("away_points_against")) / 2.0 + (
        F.col("away_points_for") + F.col("home_points_against")) / 2.0
    out = pairs.withColumns({"spread": spread, "total": total})
    out = out.withColumn("home_prob", S.spread_to_prob(F.col("spread")))
    home_total, away_total = S.team_totals(F.col("total"), F.col("spread"))
    return out.withColumns({
        "away_prob": 1.0 - F.col("home_prob"),
        "home_fair": S.prob_to_american(F.col("home_prob")),
        "away_fair": S.prob_to_american(1.0 - F.col("home_prob")),
        "home_total": home_total, "away_total": away_total,
    })


def pair_slate_lookup(pairs: DataFrame, slate: DataFrame) -> DataFrame:
    """The slate's own forecast beside a pair, or a note that it is not on it."""
    on = slate.select("away_team", "home_team", *SLATE, "pred_margin", "prob_home", "pred_total",
                      F.lit(True).alias("on"))
    status = F.when(F.col("on"), "on this slate").otherwise("not on this slate")
    return pairs.join(on, ["away_team", "home_team"], "left").withColumn("status", status).drop("on")
