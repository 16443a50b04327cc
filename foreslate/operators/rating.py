"""Pairwise rating pass: sequential state over time-ordered contests.

Every update needs both sides' latest ratings, so a league is one dependency
chain, whatever its size.  The pass streams each league's contests in order
through ``mapInArrow`` and holds only the ratings (a few numbers per team and
passer) and one batch; the sort before it spills.  Within a season of a batch,
contests whose sides have no earlier contest left are updated together as
arrays.  A lost executor repeats its leagues' pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .. import constants as K
from ..functions.scalars import clip, elo_to_spread, rest_points
from ..sources.store import materialize

OUT_FIELDS = (
    "league string, row_kind int, season int, game_id string, elo_home_pre double, "
    "elo_away_pre double, elo_diff double, elo_qb_points double, "
    "name string, entry string, value double, games double"
)


@dataclass(frozen=True)
class RatingOptions:
    k: float = K.ELO_K
    season_carry: float = K.ELO_SEASON_CARRY
    use_passer: bool = False
    use_rest: bool = True
    hfa_override: float | None = None


def home_advantage(games: DataFrame, by=("league",)) -> DataFrame:
    """Trailing-window home advantage per season, never using that season.

    Aggregated to seasons first; the range window sees one row per season.
    """
    counted = F.col("completed") & ~F.col("neutral") & ~F.col("is_playoff")
    usual = counted & ~F.col("season").isin(*K.HFA_EXCLUDED_SEASONS)
    season = games.groupBy(*by, "season").agg(
        F.count_if(counted).alias("n_all"),
        F.count_if(usual).alias("n"),
        F.sum(F.when(usual, F.col("margin"))).alias("t"),
    )
    past = W.partitionBy(*by).orderBy("season").rangeBetween(-K.HFA_SEASONS, -1)
    n_all, n = F.sum("n_all").over(past), F.sum("n").over(past)
    mean = clip(F.sum("t").over(past) / n, K.HFA_MIN, K.HFA_MAX)
    enough = (n_all >= K.HFA_MIN_GAMES) & (n >= K.HFA_MIN_GAMES)
    value = F.when(enough, mean).otherwise(F.lit(K.HFA_DEFAULT))
    for year, fixed in K.HFA_OVERRIDES.items():
        value = F.when(F.col("season") == year, F.lit(fixed)).otherwise(value)
    return season.select(*by, "season", value.alias("hfa"))


def _stream(options: RatingOptions):
    """The sequential helper.  It takes nothing of this package to the workers but numbers."""
    k, carry, with_passer = options.k, options.season_carry, options.use_passer
    start, per_point, divisor, mov = K.ELO_INIT, K.ELO_PER_POINT, K.ELO_DIVISOR, K.ELO_MOV_B
    step_down, worth, most = K.RATING_PASSER_UNKNOWN, K.RATING_PASSER_POINTS, K.RATING_PASSER_CAP
    pace, shrink, slowest = K.RATING_PASSER_ALPHA, K.RATING_PASSER_SHRINK, K.RATING_PASSER_MIN_WEIGHT
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    out_schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in OUT_FIELDS.split(", "))])

    class Table:
        """Numbers by name: a value, and how many contests taught it."""

        def __init__(self, first: float):
            self.code: dict = {}
            self.first, self.value, self.taught = first, np.zeros(0), np.zeros(0)

        def codes(self, names: list) -> np.ndarray:
            """Places of the names; -1 for none.  New names get the first value."""
            found = np.array([self.code.setdefault(n, len(self.code)) if n else -1 for n in names], np.int64)
            new = len(self.code) - len(self.value)
            self.value = np.append(self.value, np.full(new, self.first))
            self.taught = np.append(self.taught, np.zeros(new))
            return found

    def rounds(sides: list[np.ndarray]) -> list[np.ndarray]:
        """Contests in groups, each contest after all earlier ones that share a side with it."""
        last: dict[int, int] = {}
        level = []
        for places in zip(*(s.tolist() for s in sides)):
            own = [p for p in places if p >= 0]
            level.append(1 + max((last.get(p, 0) for p in own), default=0))
            last.update(dict.fromkeys(own, level[-1]))
        order = np.argsort(level, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(np.array(level)[order])) + 1)

    class League:
        def __init__(self) -> None:
            self.season = None
            self.elo, self.passer, self.usual = Table(start), Table(0.0), Table(np.nan)

        def edge(self, team: np.ndarray, passer: np.ndarray) -> np.ndarray:
            """Points a starter is worth beside the team's usual level; a new one counts a step below it."""
            usual = self.usual.value[team]
            level = np.where(self.passer.taught[passer] > 0, self.passer.value[passer], usual - step_down)
            told = np.clip((level - usual) * worth, -most, most)
            return np.where((passer < 0) | np.isnan(usual), 0.0, told)

        def teach(self, team: np.ndarray, passer: np.ndarray, seen: np.ndarray) -> None:
            """(level, starts, usual) after one more start with result ``seen``."""
            known = (passer >= 0) & ~np.isnan(seen)
            team, passer, seen = team[known], passer[known], seen[known]
            starts, level = self.passer.taught[passer], self.passer.value[passer]
            weight = np.maximum(pace * np.where(starts > 0, starts / (starts + shrink), 1 / shrink), slowest)
            level = level + weight * (seen - level)
            self.passer.value[passer], self.passer.taught[passer] = level, starts + 1
            usual = self.usual.value[team]
            self.usual.value[team] = np.where(np.isnan(usual), level, usual + pace * (level - usual))

        def play(self, rows: pd.DataFrame) -> pa.RecordBatch:
            """Pregame ratings of a run of contests of one season, in order; then what they teach."""
            season = rows["season"].iloc[0]
            if not pd.isna(season):
                if self.season is not None:
                    self.elo.value = start + carry ** (season - self.season) * (self.elo.value - start)
                self.season = int(season)
            home, away = (self.elo.codes(rows[c].tolist()) for c in ("home_team", "away_team"))
            sides = [2 * home, 2 * away]
            if with_passer:
                home_usual, away_usual = (self.usual.codes(rows[c].tolist()) for c in ("home_team", "away_team"))
                passers = [self.passer.codes(rows[c].tolist()) for c in ("home_qb", "away_qb")]
                sides += [np.where(p < 0, -1, 2 * p + 1) for p in passers]
            points, margin = (rows[c].to_numpy(float) for c in ("points", "margin"))
            before = np.zeros((4, len(rows)))
            for own in rounds(sides):
                h, a = self.elo.value[home[own]], self.elo.value[away[own]]
                extra = np.zeros(len(own))
                if with_passer:
                    extra = self.edge(home_usual[own], passers[0][own]) - self.edge(away_usual[own], passers[1][own])
                diff = h - a + (points[own] + extra) * per_point
                before[:, own] = h, a, diff, extra
                own, diff = own[(played := ~np.isnan(margin[own]))], diff[played]
                won, lead = np.sign(margin[own]), np.sign(margin[own]) * diff
                size = np.where(won == 0, 1.0, np.log1p(np.abs(margin[own])) * mov / (lead * 0.001 + mov))
                shift = k * size * ((won + 1) / 2 - 1 / (1 + 10 ** (-diff / divisor)))
                self.elo.value[home[own]] += shift
                self.elo.value[away[own]] -= shift
                if with_passer:
                    self.teach(home_usual[own], passers[0][own], rows["home_epa"].to_numpy(float)[own])
                    self.teach(away_usual[own], passers[1][own], rows["away_epa"].to_numpy(float)[own])
            told = dict(zip(("elo_home_pre", "elo_away_pre", "elo_diff", "elo_qb_points"), before))
            return packed(len(rows), row_kind=[0] * len(rows), **{c: rows[c].tolist() for c in ("league", "season", "game_id")}, **told)

        def state(self, league) -> pa.RecordBatch:
            rows = [
                (name, entry, table.value[at], table.taught[at] if entry == "passer" else None)
                for entry, table in (("team", self.elo), ("passer", self.passer), ("usual", self.usual))
                for name, at in table.code.items()
                if entry == "team" or (table.taught[at] > 0 if entry == "passer" else table.value[at] == table.value[at])
            ]
            n = len(rows)
            return packed(n, league=[league] * n, row_kind=[1] * n, season=[self.season] * n,
                          **dict(zip(("name", "entry", "value", "games"), zip(*rows))))

    def packed(n: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type, from_pandas=True) for f in out_schema], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, league = None, None
        for batch in (b.to_pandas() for b in batches if b.num_rows):
            # runs of one league and one season; the sort has put them together
            same = (batch["league"].eq(batch["league"].shift()) | batch["league"].isna() & batch["league"].shift().isna()) & (
                batch["season"].eq(batch["season"].shift()) | batch["season"].isna() & batch["season"].shift().isna())
            same.iloc[0] = False
            for _, rows in batch.groupby((~same).cumsum(), sort=False):
                own = rows["league"].iloc[0]
                if league is None or own != name:
                    if league is not None:
                        yield league.state(name)
                    name, league = own, League()
                yield league.play(rows)
        if league is not None:
            yield league.state(name)

    return run


def _prepare(games: DataFrame, team_games: DataFrame | None, options: RatingOptions) -> DataFrame:
    """Slim contest rows with the home and rest points already worked out."""
    if options.hfa_override is None:
        hfa = materialize(home_advantage(games), "home-advantage")
        base = games.join(hfa, ["league", "season"], "left")
    else:
        base = games.withColumn("hfa", F.lit(float(options.hfa_override)))
    rest = rest_points(F.col("home_rest"), F.col("away_rest")) if options.use_rest else F.lit(0.0)
    base = base.withColumns({
        "hfa": F.when(F.col("neutral"), F.lit(0.0)).otherwise(F.col("hfa")),
        "rest_pts": rest,
    })
    if options.use_passer and team_games is not None:
        seen = team_games.select("game_id", "team", "off_epa_play")
        for side in ("home", "away"):
            base = base.join(
                seen.select("game_id", F.col("team").alias(f"{side}_team"),
                            F.col("off_epa_play").alias(f"{side}_epa")),
                ["game_id", f"{side}_team"], "left",
            )
    else:
        nothing = F.lit(None).cast("double")
        base = base.withColumns({"home_epa": nothing, "away_epa": nothing})
    return base


def _text_key(df: DataFrame) -> Column:
    """Contest key as text that sorts like the key itself."""
    key = F.col("game_id")
    if isinstance(df.schema["game_id"].dataType, T.StringType):
        return key
    return F.lpad(key.cast("string"), 20, "0")


def _stream_rows(base: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    passer: dict[str, Column] = {
        f"{s}_qb": F.col(f"{s}_qb_id").cast("string") if f"{s}_qb_id" in base.columns else text
        for s in ("home", "away")
    }
    return base.select(
        "league", "season", "week", "kickoff",
        _text_key(base).alias("game_id"),
        "home_team", "away_team", (F.col("hfa") + F.col("rest_pts")).alias("points"),
        F.when(F.col("completed"), F.col("margin")).cast("double").alias("margin"),
        passer["home_qb"].alias("home_qb"), passer["away_qb"].alias("away_qb"),
        "home_epa", "away_epa",
    )


def rating_pass(
    games: DataFrame,
    team_games: DataFrame | None = None,
    options: RatingOptions = RatingOptions(),
) -> tuple[DataFrame, DataFrame]:
    """Pregame ratings per contest, and the final state rows.

    Returns ``(pregame, state)``.  Unplayed contests are rated but teach
    nothing; null seasons and weeks come first in their order.  ``state`` has league, name, entry
    (team, passer, usual), value, games and the season it stands at.
    """
    base = _prepare(games, team_games, options)
    passed = materialize(
        _stream_rows(base).repartition("league")
        .sortWithinPartitions("league", "season", "week", "kickoff", "game_id")
        .mapInArrow(_stream(options), OUT_FIELDS), "ratings")
    state = passed.where("row_kind = 1")
    pregame = passed.where("row_kind = 0").select(
        F.col("game_id").alias("__key"), "elo_home_pre", "elo_away_pre", "elo_diff", "elo_qb_points",
    )
    out = (
        base.select("game_id", "hfa", "rest_pts")
        .withColumn("__key", _text_key(base))
        .join(pregame, "__key").drop("__key")
        .select(
            "game_id", "elo_home_pre", "elo_away_pre", "elo_diff",
            (F.col("elo_home_pre") - F.col("elo_away_pre")).alias("elo_raw_diff"),
            F.col("hfa").alias("elo_hfa_points"), F.col("rest_pts").alias("elo_rest_points"),
            "elo_qb_points",
            (1.0 / (1.0 + F.pow(F.lit(10.0), -F.col("elo_diff") / K.ELO_DIVISOR))).alias("elo_prob_home"),
            elo_to_spread(F.col("elo_diff")).alias("elo_spread"),
        )
    )
    return out, state.select("league", "name", "entry", "value", "games", "season")


def current_ratings(state: DataFrame) -> DataFrame:
    """Final ratings with their worth in points; order by ``elo`` descending."""
    return state.where(F.col("entry") == "team").select(
        "league", F.col("name").alias("team"), F.col("value").alias("elo"),
        elo_to_spread(F.col("value") - K.ELO_INIT).alias("spread_vs_average"),
    )
