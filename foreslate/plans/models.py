"""Fits and predictions.

Linear parts come from cross-product matrices: one aggregation gives the
sums of products, running sums over the clock give them for every cutoff, and
each fit is a tiny solve on (p + 1)^2 numbers.  Logistic curves take Newton
steps from sums; boosted trees are grown in :mod:`boosting`.  All linear predictions are plain Column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators.aggregates import fit_facts
from .boosting import Boost, Forest, Target, fit_forests, forest_score

# --------------------------------------------------------------------------
# ridge from cross-products
# --------------------------------------------------------------------------


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def cross_products(rows: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of [1, features, target]; partial sums before the shuffle."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    return rows.groupBy(*by).agg(
        *[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in _pairs(len(cols))]
    )


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray, float]:
    """Intercept, coefficients and residual spread on standardised features.

    A constant feature gets scale 1 and so coefficient 0.
    """
    n, p = gram[0, 0], len(gram) - 2
    mean = gram[0, 1:] / n
    centered = gram[1:, 1:] - n * np.outer(mean, mean)
    sxx, sxy, syy = centered[:p, :p], centered[:p, p], centered[p, p]
    variance = np.clip(np.diag(sxx) / n, 0.0, None)
    flat = variance <= 1e-12 * np.maximum(1.0, mean[:p] ** 2)
    scale = np.where(flat, 1.0, np.sqrt(variance))
    standard = sxx / np.outer(scale, scale)
    standard[flat, :] = standard[:, flat] = 0.0
    right = np.where(flat, 0.0, sxy / scale)
    beta = np.linalg.solve(standard + alpha * np.eye(p), right) / scale
    rss = syy - 2 * beta @ sxy + beta @ sxx @ beta
    return float(mean[p] - beta @ mean[:p]), beta, float(np.sqrt(max(rss, 0.0) / n))


def _solver(keys: Sequence[str], size: int, alpha: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                gram = np.zeros((size, size))
                for i, j in _pairs(size):
                    gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
                intercept, beta, sigma = solve_ridge(gram, alpha)
                out.append((*[row[k] for k in keys], int(gram[0, 0]), intercept, beta.tolist(), sigma))
            yield pd.DataFrame(out, columns=[*keys, "n_train", "intercept", "beta", "sigma"])

    return run


def _solved(gram: DataFrame, keys: Sequence[str], size: int, alpha: float) -> DataFrame:
    lead = ", ".join(f"{k} {gram.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{lead + ', ' if lead else ''}n_train long, intercept double, beta array<double>, sigma double"
    return gram.mapInPandas(_solver(keys, size, alpha), schema)


def ridge_fit(rows: DataFrame, features: Sequence[str], target: str,
              alpha: float = K.RIDGE_ALPHA, by: Sequence[str] = ()) -> DataFrame:
    """One fitted row (per group): n_train, intercept, beta, residual sigma."""
    known = rows.where(F.col(target).isNotNull())
    gram = cross_products(known, features, target, by)
    return _solved(gram.where(F.col("g0_0") > 0), by, len(features) + 2, alpha)


def ridge_by_cutoff(rows: DataFrame, features: Sequence[str], target: str, clock: str = "period",
                    alpha: float = K.RIDGE_ALPHA, minimum: int = 2) -> DataFrame:
    """A fit on the rows before every clock value, from one pass over the rows.

    The running window sees one row per clock value.
    """
    size = len(features) + 2
    known = rows.where(F.col(target).isNotNull())
    per = cross_products(known, features, target, [clock])
    clocks = rows.select(clock).distinct()
    past = W.orderBy(clock).rowsBetween(W.unboundedPreceding, -1)
    gram = clocks.join(per, clock, "left").select(
        clock, *[F.sum(f"g{i}_{j}").over(past).alias(f"g{i}_{j}") for i, j in _pairs(size)]
    )
    return _solved(gram.where(F.col("g0_0") >= minimum), [clock], size, alpha)


def linear_score(features: Sequence[str], intercept: Column, beta: Column) -> Column:
    """intercept + beta . features with the coefficients in array columns."""
    out = intercept
    for i, name in enumerate(features):
        out = out + F.get(beta, F.lit(i)) * F.col(name)
    return out


def fixed_score(features: Sequence[str], intercept: float, beta: Sequence[float]) -> Column:
    out = F.lit(float(intercept))
    for name, b in zip(features, beta):
        out = out + F.lit(float(b)) * F.col(name)
    return out


# --------------------------------------------------------------------------
# linear fits at many cutoffs, a fixed number of passes for all of them
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearFit:
    n_train: int
    intercept: float
    beta: list[float]
    sigma: float | None = None


def ridge_at(rows: DataFrame, features: Sequence[str], target: str, clock: str, cutoffs: Sequence,
             alpha: float = K.RIDGE_ALPHA) -> dict:
    """Ridge fits on the rows before each cutoff, from one aggregation.

    Rows are summed per gap between cutoffs; what reaches the driver is one
    small matrix per refit.
    """
    cutoffs = sorted(cutoffs)
    size = len(features) + 2
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: c <= F.col(clock)))
    known = rows.where(F.col(target).isNotNull() & (F.col(clock) < F.lit(cutoffs[-1])))
    gaps = cross_products(known.withColumn("__gap", passed), features, target, ["__gap"]).collect()
    parts = {r["__gap"]: r for r in gaps}
    gram, out = np.zeros((size, size)), {}
    for index, cutoff in enumerate(cutoffs):
        if index in parts:
            for i, j in _pairs(size):
                gram[i, j] += parts[index][f"g{i}_{j}"]
                gram[j, i] = gram[i, j]
        if gram[0, 0] > 0:
            intercept, beta, sigma = solve_ridge(gram, alpha)
            out[cutoff] = LinearFit(int(gram[0, 0]), intercept, beta.tolist(), sigma)
    return out


def _newton_sums(cutoffs: np.ndarray, betas: np.ndarray, live: np.ndarray):
    """Per task: loss, gradient and curvature sums of every open cutoff."""
    size = betas.shape[1]
    upper = np.triu_indices(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(cutoffs), 2 + size + len(upper[0])))
        for batch in batches:
            body = batch.to_numpy(dtype=float)
            clock, y = body[:, 0], body[:, 1]
            x = np.column_stack([np.ones(len(body)), body[:, 2:]])
            for k in np.flatnonzero(live):
                mine = clock < cutoffs[k]
                xs, ys = x[mine], y[mine]
                z = xs @ betas[k]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                # a sum of small terms, not a difference of large ones
                loss = np.logaddexp(0.0, np.where(ys > 0.5, -z, z)).sum()
                curve = (xs * (p * (1 - p))[:, None]).T @ xs
                sums[k] += np.concatenate([[len(ys), loss], xs.T @ (ys - p), curve[upper]])
        index = np.flatnonzero(live)
        width = sums.shape[1]
        yield pd.DataFrame({
            "k": np.repeat(index, width), "pos": np.tile(np.arange(width), len(index)),
            "v": sums[index].ravel(),
        })

    return run


def logistic_at(rows: DataFrame, features: Sequence[str], label: Column, clock: str, cutoffs: Sequence,
                c: float, standardize: bool = True, minimum: int = 1, steps: int = 60) -> dict:
    """L2 logistic fits on the rows before each cutoff, all by Newton together.

    One pass per step serves every cutoff still moving, so the number of jobs
    does not grow with the number of refits.  Tasks send sums, never rows.  A
    step that does not lower the penalised loss is halved.
    """
    cutoffs = sorted(cutoffs)
    features = list(features)
    size, count = len(features) + 1, len(cutoffs)
    slim = rows.where(F.col(clock) < F.lit(cutoffs[-1])).select(
        F.col(clock).cast("double").alias("__clock"), label.cast("double").alias("__y"),
        *[F.col(f).cast("double") for f in features])

    # spread of each feature before each cutoff, which scales the penalty
    later = F.filter(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(v)).alias("c")) for i, v in enumerate(cutoffs)]),
                     lambda s: s["c"] > F.col("__clock"))
    passed = F.lit(count) - F.size(later)
    gaps = slim.groupBy(passed.alias("gap")).agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f"s_{f}") for f in features],
        *[F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features]).collect()
    n, s, q = np.zeros(count), np.zeros((count, size - 1)), np.zeros((count, size - 1))
    for row in gaps:
        g = row["gap"]
        n[g:] += row["n"]
        s[g:] += [row[f"s_{f}"] for f in features]
        q[g:] += [row[f"q_{f}"] for f in features]
    spread = np.clip(q / np.maximum(n, 1)[:, None] - (s / np.maximum(n, 1)[:, None]) ** 2, 0, None)
    ridge = (spread if standardize else np.ones_like(spread)) / c
    penalty = np.column_stack([np.zeros(count), np.where(ridge > 0, ridge, 1.0)])

    upper = np.triu_indices(size)
    best, best_loss = np.zeros((count, size)), np.full(count, np.inf)
    trial, live = best.copy(), n >= minimum
    points = np.array([float(v) for v in cutoffs])
    for _ in range(steps):
        if not live.any():
            break
        sent = slim.mapInPandas(_newton_sums(points, trial, live), "k long, pos long, v double")
        table = np.zeros((count, 2 + size + len(upper[0])))
        for row in sent.groupBy("k", "pos").agg(F.sum("v").alias("v")).collect():
            table[row["k"], row["pos"]] = row["v"]
        for k in np.flatnonzero(live):
            loss = table[k, 1] + 0.5 * (penalty[k] * trial[k] ** 2).sum()
            if loss > best_loss[k] * (1.0 + 1e-13):
                trial[k] = (best[k] + trial[k]) / 2.0
                live[k] = np.abs(trial[k] - best[k]).max() > 1e-8 * max(1.0, np.abs(best[k]).max())
                continue
            best[k], best_loss[k] = trial[k], loss
            curve = np.zeros((size, size))
            curve[upper] = table[k, 2 + size:]
            curve = curve + np.triu(curve, 1).T + np.diag(penalty[k])
            slope = table[k, 2:2 + size] - penalty[k] * best[k]
            scale = 1.0 / np.sqrt(np.maximum(np.diag(curve), 1e-300))
            step = scale * np.linalg.lstsq(curve * np.outer(scale, scale), scale * slope, rcond=None)[0]
            trial[k] = best[k] + step
            # where rows are told apart almost wholly the loss is flat long before the coefficients stand still
            live[k] = (slope @ step > 1e-12 * max(1e-2, loss)
                       or np.abs(step).max() > 1e-8 * max(1.0, np.abs(best[k]).max()))
            if not live[k]:  # a last full step: what is left after it is of second order
                best[k] = trial[k]
    if live.any():
        raise RuntimeError(f"{int(live.sum())} of {count} fits had not settled after {steps} steps")
    return {
        cutoff: LinearFit(int(n[k]), float(best[k, 0]), best[k, 1:].tolist())
        for k, cutoff in enumerate(cutoffs) if n[k] >= minimum
    }


# --------------------------------------------------------------------------
# single fits
# --------------------------------------------------------------------------


def logistic_curve(rows: DataFrame, features: Sequence[str], label: Column, c: float,
                   standardize: bool = True) -> tuple[float, list[float]]:
    """L2 logistic fit with inverse strength ``c`` on all rows: intercept and coefficients."""
    fit = logistic_at(rows.withColumn("__all", F.lit(0.0)), features, label, "__all", [1.0], c, standardize)[1.0]
    return fit.intercept, fit.beta


def decided_label() -> Column:
    """1 for a home win, 0 for a loss, null where nothing was decided."""
    return F.when(F.col("completed") & (F.col("margin") != 0), (F.col("margin") > 0).cast("double"))


def boosted(rows: DataFrame, targets: Sequence[Target], boost: Boost, minimum: int) -> dict[str, Forest]:
    """Forests by target on all rows; of the fit store where the same history was fitted before."""
    if not boost.rounds:
        return {}
    found = fit_forests(rows.withColumn("__all", F.lit(0.0)), "__all", [1.0], targets, boost, minimum, own_edges=True)
    return {name: forest for (name, _), forest in found.items()}


@dataclass
class WinnerModel:
    """Outright winner: logistic, margin ridge and boosted trees in log-odds."""

    features: list[str]
    logistic: tuple[float, list[float]]
    margin: tuple[float, list[float]]
    margin_sigma: float
    boost: Forest | None
    market: tuple[float, list[float]] | None
    n_train: int
    seasons: list[int] = field(default_factory=list)

    def predict(self, frame: DataFrame, use_market: bool = True, blend: float = K.MARKET_BLEND) -> DataFrame:
        base = frame
        if self.boost is not None:
            base = frame.withColumn("__boost", S.expit(forest_score({"all": self.boost})))
        margin = fixed_score(self.features, *self.margin)
        parts = {
            "logistic": S.expit(fixed_score(self.features, *self.logistic)),
            "margin": S.spread_to_prob(margin, self.margin_sigma),
        }
        if self.boost is not None:
            parts["boost"] = F.col("__boost")
        quoted = None if self.market is None else S.expit(fixed_score(["market_spread"], *self.market))
        return winner_columns(base, parts, margin, F.lit(self.margin_sigma), quoted, use_market, blend).drop("__boost")


def ensemble_probability(parts: dict[str, Column]) -> Column:
    """Weighted mean in log-odds over the parts that are present in the row."""
    weight = total = F.lit(0.0)
    for k, p in parts.items():
        weight = weight + F.when(p.isNotNull(), K.WINNER_WEIGHTS[k]).otherwise(0.0)
        total = total + F.coalesce(K.WINNER_WEIGHTS[k] * S.safe_logit(p), F.lit(0.0))
    return S.expit(total / weight)


def market_probability(frame: DataFrame, curve: Column | None) -> Column:
    """Spread curve, replaced by the vig-free two-way price where there is one."""
    out = F.lit(None).cast("double") if curve is None else curve
    if {"home_moneyline", "away_moneyline"} <= set(frame.columns):
        out = F.coalesce(S.devig_moneyline(F.col("home_moneyline"), F.col("away_moneyline")), out)
    return out


def blend_probability(model: Column, market: Column, blend: float) -> Column:
    """Log-odds blend where the market is priced, the model alone elsewhere."""
    mixed = S.expit(blend * S.safe_logit(model) + (1.0 - blend) * S.safe_logit(market))
    return F.when(market.isNull(), model).otherwise(mixed)


def winner_columns(frame, parts, margin, sigma, curve, use_market, blend) -> DataFrame:
    out = frame.withColumns({
        "model_prob_home": ensemble_probability(parts),
        "model_margin": margin,
        "market_prob_home": market_probability(frame, curve),
    })
    model, market = F.col("model_prob_home"), F.col("market_prob_home")
    used = blend_probability(model, market, blend) if use_market else model
    out = out.withColumn("prob_home", used)
    return out.withColumn("pred_margin", S.prob_to_spread(F.col("prob_home"), sigma))


def winner_training(games: DataFrame) -> DataFrame:
    """Completed, non-tied contests."""
    return games.where(F.col("completed") & F.col("margin").isNotNull() & (F.col("margin") != 0))


def home_won() -> Column:
    return F.col("margin") > 0


def winner_curve(train: DataFrame, features: Sequence[str]) -> tuple[float, list[float]]:
    """The logistic part of the winner model."""
    return logistic_curve(train, list(features), home_won(), K.LOGISTIC_C)


def market_curve(train: DataFrame) -> tuple[float, list[float]]:
    """Home wins by the quoted spread, on the contests that have one."""
    return logistic_curve(train.where(F.col("market_spread").isNotNull()), ["market_spread"],
                          home_won(), K.MARKET_C, standardize=False)


def fit_winner(history: DataFrame, features: Sequence[str] = K.WINNER_FEATURES + K.PASSER_FEATURES,
               boost: Boost = Boost(), min_boost: int = K.MIN_BOOST_GAMES,
               min_priced: int = K.MIN_PRICED_GAMES) -> WinnerModel:
    features = list(features)
    train = winner_training(history)
    facts = train.agg(
        F.count("*").alias("n"), F.count("market_spread").alias("priced"),
        F.sort_array(F.collect_set("season")).alias("seasons"),
    ).first()
    if not facts["n"]:
        raise ValueError("no completed, non-tied games to train on")
    ridge = ridge_fit(train, features, "margin").first()
    whole = history.where("completed").withColumn("__won", decided_label())
    trees = boosted(whole, [Target("winner", tuple(features), "__won", True)], boost, min_boost).get("winner")
    market = None
    if facts["priced"] >= min_priced:
        market = market_curve(train)
    return WinnerModel(
        features, winner_curve(train, features),
        (ridge["intercept"], list(ridge["beta"])),
        min(max(ridge["sigma"], K.MARGIN_SIGMA_BOUNDS[0]), K.MARGIN_SIGMA_BOUNDS[1]),
        trees, market, facts["n"], list(facts["seasons"]),
    )


def mixed_total(ridge: Column, trees: Column) -> Column:
    w = K.TOTAL_WEIGHTS
    return (w["ridge"] * ridge + w["boost"] * trees) / (w["ridge"] + w["boost"])


@dataclass
class TotalModel:
    """Point total: ridge and boosted trees in points."""

    features: list[str]
    ridge: tuple[float, list[float]]
    boost: Forest | None
    sigma: float = K.TOTAL_SIGMA
    train_mae: float | None = None
    n_train: int = 0

    def score(self, frame: DataFrame) -> DataFrame:
        ridge = fixed_score(self.features, *self.ridge)
        if self.boost is None:
            return frame.withColumn("model_total", ridge)
        return frame.withColumn("model_total", mixed_total(ridge, forest_score({"all": self.boost})))

    def predict(self, frame: DataFrame, use_market: bool = True, blend: float = K.TOTAL_BLEND) -> DataFrame:
        return total_columns(self.score(frame), F.lit(self.sigma), use_market, blend)


def total_columns(frame: DataFrame, sigma: Column, use_market: bool = True,
                  blend: float = K.TOTAL_BLEND) -> DataFrame:
    """Blend, both edges, over and push chances and the pick from ``model_total``."""
    model = F.col("model_total")
    line = F.col("market_total") if "market_total" in frame.columns else F.lit(None).cast("double")
    mixed = F.when(line.isNull(), model).otherwise(blend * model + (1.0 - blend) * line)
    out = frame.withColumns({"market_total": line, "pred_total": mixed if use_market else model})
    line, used = F.col("market_total"), F.col("pred_total")
    return out.withColumns({
        "model_edge": model - line,
        "total_edge": used - line,
        "prob_over": S.over_probability(used, line, sigma),
        "prob_over_model": S.over_probability(model, line, sigma),
        "prob_push": F.when(line.isNotNull(), S.push_probability(used, line, sigma)).otherwise(0.0),
        "ou_pick": F.when(line.isNull(), "-").when(used > line, "OVER").otherwise("UNDER"),
    })


def with_total(games: DataFrame) -> DataFrame:
    return games.withColumn("actual_total", S.actual_total(F.col("home_score"), F.col("away_score")))


def fit_total(history: DataFrame, features: Sequence[str] = K.TOTAL_FEATURES, boost: Boost = Boost(),
              min_boost: int = K.MIN_BOOST_GAMES) -> TotalModel:
    features = list(features)
    train = with_total(history).where(F.col("completed") & F.col("actual_total").isNotNull())
    ridge = ridge_fit(train, features, "actual_total").first()
    if ridge is None:
        raise ValueError("no completed games with a final score to train on")
    model = TotalModel(features, (ridge["intercept"], list(ridge["beta"])), None, n_train=ridge["n_train"])
    model.boost = boosted(train, [Target("total", tuple(features), "actual_total")], boost, min_boost).get("total")
    facts = fit_facts(model.score(train), F.col("model_total"), F.col("actual_total")).first()
    model.sigma = min(max(facts["sigma"], K.TOTAL_SIGMA_BOUNDS[0]), K.TOTAL_SIGMA_BOUNDS[1])
    model.train_mae = facts["train_mae"]
    return model


# --------------------------------------------------------------------------
# halves
# --------------------------------------------------------------------------


def fit_halves(frame: DataFrame, minimum: int = K.HALF_MIN_GAMES) -> DataFrame:
    """Two least-squares lines in one aggregate; fixed shares below ``minimum``."""
    known = frame.where(
        F.col("pred_total").isNotNull() & F.col("pred_margin").isNotNull()
        & F.col("first_half_total").isNotNull() & F.col("first_half_margin").isNotNull()
    )

    def line(kind: str) -> list[Column]:
        y, x = F.col(f"first_half_{kind}"), F.col(f"pred_{kind}")
        spread = F.sqrt(F.greatest(
            F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2.0)) / F.regr_sxx(y, x), F.lit(0.0)
        ) / F.count("*"))
        return [F.regr_slope(y, x).alias(f"{kind}_slope"),
                F.regr_intercept(y, x).alias(f"{kind}_intercept"), spread.alias(f"{kind}_sigma")]

    facts = known.agg(F.count("*").alias("n_train"), *line("total"), *line("margin"))
    enough = F.col("n_train") >= minimum
    return facts.select(
        "n_train", enough.alias("fitted_from_history"),
        F.when(enough, F.col("total_slope")).otherwise(F.lit(K.HALF_TOTAL_SHARE)).alias("total_slope"),
        F.when(enough, F.col("total_intercept")).otherwise(F.lit(0.0)).alias("total_intercept"),
        F.when(enough, F.col("total_sigma")).alias("total_sigma"),
        F.when(enough, F.col("margin_slope")).otherwise(F.lit(K.HALF_MARGIN_SLOPE)).alias("margin_slope"),
        F.when(enough, F.col("margin_intercept")).otherwise(F.lit(0.0)).alias("margin_intercept"),
        F.when(enough, F.col("margin_sigma")).alias("margin_sigma"),
    )


def predict_halves(frame: DataFrame, fit: DataFrame) -> DataFrame:
    """Team totals and half lines; the second half is what the first leaves over.

    ``fit`` is the single row of :func:`fit_halves`; its four numbers become
    literals of the projection.
    """
    line = fit.first()
    total, margin = F.col("pred_total"), F.col("pred_margin")
    home, away = S.team_totals(total, margin)
    out = frame.withColumns({
        "home_team_total": home, "away_team_total": away,
        "first_half_total_pred": line["total_slope"] * total + line["total_intercept"],
        "first_half_margin_pred": line["margin_slope"] * margin + line["margin_intercept"],
    })
    half_total, half_margin = F.col("first_half_total_pred"), F.col("first_half_margin_pred")
    fh_home, fh_away = S.team_totals(half_total, half_margin)
    return out.withColumns({
        "fh_home_total": fh_home, "fh_away_total": fh_away,
        "second_half_total_pred": total - half_total,
        "second_half_margin_pred": margin - half_margin,
    })


# --------------------------------------------------------------------------
# player yardage
# --------------------------------------------------------------------------


def involved(rows: DataFrame, target: str) -> DataFrame:
    """Rows with production or volume for a target."""
    return rows.where(
        F.col(target).isNotNull() & ((F.col(target) > 0) | (F.col(K.PLAYER_TARGETS[target]) > 0))
    )


@dataclass
class PlayerModel:
    features: list[str]
    ridge: dict[str, tuple[float, list[float]]]
    boost: dict[str, Forest]
    n_train: dict[str, int]

    def _value(self, frame: DataFrame, target: str) -> DataFrame:
        name = f"proj_{target}"
        if target not in self.ridge:
            return frame.withColumn(name, F.lit(None).cast("double"))
        value = fixed_score(self.features, *self.ridge[target])
        if target in self.boost:
            w = K.PLAYER_WEIGHTS
            value = w["ridge"] * value + w["boost"] * forest_score({"all": self.boost[target]})
        return frame.withColumn(name, value)

    def raw(self, frame: DataFrame) -> DataFrame:
        for target in K.PLAYER_TARGETS:
            frame = self._value(frame, target)
        return frame

    def predict(self, frame: DataFrame) -> DataFrame:
        """Projection floored at 0 and scaled by the chance of playing."""
        out = self.raw(frame)
        return out.withColumns({
            f"proj_{t}": floor_projection(F.col(f"proj_{t}"), F.col("availability"))
            for t in K.PLAYER_TARGETS
        })


def floor_projection(value: Column, availability: Column) -> Column:
    return F.when(value < 0, F.lit(0.0)).otherwise(value) * availability


def fit_players(history: DataFrame, features: Sequence[str] = K.PLAYER_FEATURES, boost: Boost = Boost(),
                minimum: int = K.MIN_PLAYER_ROWS, min_boost: int = K.MIN_PLAYER_BOOST_ROWS) -> PlayerModel:
    """One fit per target on rows involved in it.

    The three ridges share one scan: each row is repeated only for the
    targets it is involved in, and the cross-products are grouped by target.
    """
    features = list(features)
    tags = F.array_compact(F.array(*[
        F.when(
            F.col(t).isNotNull() & ((F.col(t) > 0) | (F.col(v) > 0)),
            F.struct(F.lit(t).alias("target"), F.col(t).alias("y")),
        ) for t, v in K.PLAYER_TARGETS.items()
    ]))
    long = history.select(*features, F.explode(tags).alias("__t")).select(*features, "__t.*")
    fits = {r["target"]: r for r in ridge_fit(long, features, "y", by=["target"]).collect()}
    fits = {t: r for t, r in fits.items() if r["n_train"] >= minimum}
    if not fits:
        raise ValueError("no target had enough player-games to fit")
    labelled = history.withColumns({
        f"__y_{t}": F.when((F.col(t) > 0) | (F.col(K.PLAYER_TARGETS[t]) > 0), F.col(t)) for t in fits})
    trees = boosted(labelled, [Target(t, tuple(features), f"__y_{t}") for t in fits], boost, min_boost)
    return PlayerModel(
        features, {t: (r["intercept"], list(r["beta"])) for t, r in fits.items()}, trees,
        {t: r["n_train"] for t, r in fits.items()},
    )
