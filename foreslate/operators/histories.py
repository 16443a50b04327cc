"""Expanding history: statistics of all rows before each of many cutoffs, without repeating a row.

Rows are reduced to one mergeable state per gap between neighbouring cutoffs; a cutoff's statistics are the
states of all gaps before it, merged forward.  Cutoffs are a table: none is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scans import asof_backward


@dataclass(frozen=True)
class State:
    """An aggregate of rows whose results merge into those of larger sets, and what is read from it."""

    start: Column
    merge: Callable[[Column], Column]
    read: Callable[[Column], Column]


def _same(c: Column) -> Column:
    return c


def total(c: Column) -> State:
    """Sum; null without values."""
    return State(F.sum(c), F.sum, _same)


def counted(condition: Column) -> State:
    """Number of rows for which the condition holds; 0 without rows."""
    return State(F.count_if(condition), F.sum, lambda c: F.coalesce(c, F.lit(0)))


def least(c: Column) -> State:
    return State(F.min(c), F.min, _same)


def greatest(c: Column) -> State:
    return State(F.max(c), F.max, _same)


def distinct_about(c: Column) -> State:
    """Number of distinct values by a HyperLogLog sketch (about 1.6 % off); 0 without values."""
    return State(F.hll_sketch_agg(c), F.hll_union_agg, lambda s: F.coalesce(F.hll_sketch_estimate(s), F.lit(0)))


def quantile_about(c: Column, share: float) -> State:
    """A quantile by a KLL sketch (rank about 1.3 % off); null without values."""
    sketch = lambda s: F.kll_sketch_get_quantile_double(s, F.lit(share))
    return State(F.kll_sketch_agg_double(c.cast("double")), F.kll_merge_agg_double,
                 lambda s: F.when(F.kll_sketch_get_n_double(s) > 0, sketch(s)))


def expanding_states(rows: DataFrame, cutoffs: DataFrame, clock: str, cutoff: str, states: dict[str, State]) -> DataFrame:
    """One row per distinct non-null cutoff: the states of all rows whose clock is strictly earlier.

    ``clock`` and ``cutoff`` are numbers of one type (seconds or days for times).  Rows with a null clock are in
    no history.  A cutoff without history has counts 0 and nulls elsewhere.  Rows are combined by clock value
    before anything is sorted; the last window reads one row per cutoff.
    """
    points = cutoffs.select((-F.col(cutoff)).alias("_at")).where("_at IS NOT NULL").distinct()
    one = F.lit(1).alias("_one")
    per = rows.where(F.col(clock).isNotNull()).groupBy((-F.col(clock)).alias("_at")).agg(
        *[s.start.alias(n) for n, s in states.items()])
    # against negated clocks, the last cutoff strictly before a row is the first one strictly after it
    gaps = asof_backward(per.select("*", one), points.select("_at", one, F.col("_at").alias("_next")),
                         key=["_one"], clock="_at", values=["_next"])
    gaps = gaps.where("_next IS NOT NULL").groupBy("_next").agg(*[s.merge(F.col(n)).alias(n) for n, s in states.items()])
    past = W.orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = points.join(gaps, points["_at"] == gaps["_next"], "left")
    merged = every.select("_at", *[s.merge(F.col(n)).over(past).alias(n) for n, s in states.items()])
    return merged.select((-F.col("_at")).alias(cutoff), *[s.read(F.col(n)).alias(n) for n, s in states.items()])
