"""Prior-only windows: decayed scans, prior baselines, strict as-of joins.

Scans and as-of joins follow one shape.  Rows are sorted over all partitions by
(key, time) and read once as a stream; a partition leaves one boundary row, which says what
it hands on to the next; boundary rows are folded in order, and what comes in
from before is added to the rows of the partition's first key.  A key that owns a third
of all rows therefore spreads over a third of the partitions, at any length of
history, and no calendar unit bounds or splits anything.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..sources.shipping import ship_package
from ..sources.store import materialize


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def sorted_ranges(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """Sorted over all partitions, nulls first; AQE may join small neighbours unless ``parts`` is given."""
    order = [F.col(f"`{c}`").asc_nulls_first() for c in columns]
    dealt = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    return dealt.sortWithinPartitions(*order)


def _changes(batch: pa.RecordBatch, names: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row's names differ from those of the row before it (nulls are equal), and the last row's."""
    new = np.zeros(batch.num_rows, bool)
    if before is None:
        new[0] = True
    for i, name in enumerate(names):
        column = batch[name]
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
        if before is not None:
            new[0] |= column[0].as_py() != before[i]
    return new, tuple(batch[n][batch.num_rows - 1].as_py() for n in names)


# --------------------------------------------------------------------------
# decayed scan
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Recurrence:
    """s <- decay * s + gain * x per observed x; a seeded one starts at the first x."""

    decay: float
    gain: float
    seeded: bool


def ewma(alpha: float) -> Recurrence:
    """s <- s + alpha (x - s), seeded by the first observation."""
    return Recurrence(1.0 - alpha, alpha, True)


def decayed_sum(alpha: float) -> Recurrence:
    """s <- (1 - alpha) s + x, from 0."""
    return Recurrence(1.0 - alpha, 1.0, False)


def running_sum() -> Recurrence:
    return Recurrence(1.0, 1.0, False)


class _Stream:
    """The scan of one partition's sorted rows.

    A run is the rows of one entity; a segment the part of a run in which no restart
    column changes.  What a stretch of rows does to a state is an affine map: a batch is cut into as many lanes as a
    lane has rows, all lanes take a step together, then each takes in what the lanes before it leave.  So a batch takes
    twice the square root of its rows in steps, whether it holds many entities or a part of one.  What is held is one batch and the open run's states.
    """

    def __init__(self, keys: Sequence[str], restart: Sequence[str], rules: dict[str, Recurrence]):
        self.keys, self.restart, self.names = list(keys), list(restart), list(rules)
        self.decay = np.array([r.decay for r in rules.values()])
        self.gain = np.array([r.gain for r in rules.values()])
        self.seeded = np.array([r.seeded for r in rules.values()])
        self.empty = np.where(self.seeded, np.nan, 0.0)
        self.least = np.where(self.decay > 0, 5e-324, 0.0)
        self.owner = self.segment = None
        self.first_owner = self.first_segment = None
        self.runs = self.segments = 0                      # seen so far; segments of the first run only
        none = np.full(len(rules), np.nan)
        self.first_in_segment, self.first_in_run = none.copy(), none.copy()
        #: of the open run: state and count in its segment, what it entered with and after how many
        #: observations, state and count in the whole run
        self.open = tuple(x.copy() for x in (self.empty, none * 0, self.empty, none * 0, self.empty, none * 0))

    def _lanes(self, fade: np.ndarray, told: np.ndarray, new: np.ndarray) -> np.ndarray:
        """What the rows of a piece so far, each s <- fade * s + told, leave of nothing."""
        n, width = told.shape
        rows = int(np.ceil(np.sqrt(n)))
        lanes = -(-n // rows)
        cut = lambda a, fill: np.concatenate([a, np.full((lanes * rows - n, *a.shape[1:]), fill)]).reshape(lanes, rows, *a.shape[1:])
        fade, told, new = cut(fade, 1.0), cut(told, 0.0), cut(new, False)[:, :, None]
        state, faded = np.zeros((lanes, width)), np.ones((lanes, width))
        for j in range(rows):
            state = np.where(new[:, j], told[:, j], fade[:, j] * state + told[:, j])
            # a faded infinity stays one
            faded = np.maximum(faded * fade[:, j], self.least)
            told[:, j], fade[:, j] = state, faded
        whole, comes, before = ~new.any(axis=1), np.zeros((lanes, width)), np.zeros(width)
        for i in range(lanes):
            comes[i] = before
            before = told[i, -1] + fade[i, -1] * before if whole[i, 0] else told[i, -1]
        told += np.where(np.cumsum(new, axis=1) == 0, fade * comes[:, None], 0.0)
        return told.reshape(-1, width)[:n]

    def _folded(self, x: np.ndarray, new: np.ndarray, state: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """State and count before every row, and after the last; a piece begins where ``new`` is set.

        Rows before the first such place go on with ``state`` and ``count``.
        """
        n = len(x)
        has, place = ~np.isnan(x), np.arange(n)
        start = np.maximum.accumulate(np.where(new, place, 0))
        going = (np.cumsum(new) == 0)[:, None]
        seen = np.cumsum(has, axis=0)
        here = seen - (seen - has)[start]                      # observations of the piece in this batch, the row's too
        unborn = self.seeded & ~(going & ~np.isnan(state))     # no state comes in: the first observation is the state
        fade = np.where(has, self.decay, 1.0)
        told = np.where(has, np.where(unborn & (here == 1), x, self.gain * x), 0.0)
        told = self._lanes(fade, told, new)
        comes = going & ~np.isnan(state)
        told = np.where(comes, told + np.maximum(self.decay ** here, self.least) * np.where(np.isnan(state), 0.0, state), told)
        told[unborn & (here == 0)] = np.nan
        number = here + np.where(going, count, 0.0)
        states, counts = np.empty_like(told), np.empty_like(told)
        states[1:], counts[1:] = told[:-1], number[:-1]
        states[new], counts[new] = self.empty, 0.0
        if not new[0]:
            states[0], counts[0] = state, count
        return states, counts, told[-1].copy(), number[-1].copy()

    def read(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """state, count, entered, entered_after (rows x values) and zone of every row."""
        n, width = batch.num_rows, len(self.names)
        begins, owner = _changes(batch, self.keys, self.owner)
        turns, segment = _changes(batch, self.restart, self.segment) if self.restart else (np.zeros(n, bool), ())
        if self.owner is None:
            self.first_owner = tuple(batch[k][0].as_py() for k in self.keys)
            self.first_segment = tuple(batch[k][0].as_py() for k in self.restart)
        self.owner, self.segment = owner, segment
        turns &= ~begins
        x = np.column_stack([batch[v].cast(pa.float64()).to_numpy(zero_copy_only=False) for v in self.names]).astype(float)

        # 0: not of the partition's first run; 1: of its first segment; 2: of a later one
        number = self.runs + np.cumsum(begins)
        first = number == 1
        place = self.segments + np.cumsum(turns & first)
        zone = np.where(first, np.where(place == 0, 1, 2), 0)
        for own, kept in ((zone == 1, self.first_in_segment), (first, self.first_in_run)):
            seen = ~np.isnan(x) & own[:, None]
            at = seen.argmax(axis=0)
            fill = seen.any(axis=0) & np.isnan(kept)
            kept[fill] = x[at, np.arange(width)][fill]
        self.runs, self.segments = int(number[-1]), int(place[-1])

        state, count, entered, after, whole, total = self.open
        new = begins | turns
        out = {}
        out["state"], out["count"], state, count = self._folded(x, new, state, count)
        if self.restart:
            wholes, totals, whole, total = self._folded(x, begins, whole, total)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out["entered"] = np.where(start[:, None] < 0, entered, wholes[start])
            out["entered_after"] = np.where(start[:, None] < 0, after, totals[start])
            entered, after = out["entered"][-1].copy(), out["entered_after"][-1].copy()
        else:
            whole, total = state, count
            if new.any():
                entered, after = self.empty.copy(), np.zeros(width)
        self.open = (state, count, entered, after, whole, total)
        return out | {"x": x, "zone": zone}

    def boundary(self) -> dict:
        """What the partition hands on, and what it needs to take something in."""
        return {
            "first": repr(self.first_owner), "first_segment": repr(self.first_segment), "last": repr(self.owner),
            "last_segment": repr(self.segment), "one_run": self.runs == 1, "one_segment": self.segments == 0,
            "x_segment": self.first_in_segment.tolist(), "x_run": self.first_in_run.tolist(),
            **{k: v.tolist() for k, v in zip(("state", "count", "entered", "after", "whole", "total"), self.open)},
        }


def _joined(local: np.ndarray, n: np.ndarray, before: np.ndarray, first: np.ndarray, rules: Sequence[Recurrence]) -> np.ndarray:
    """The state that ``n`` observations leave, of what they leave from nothing and the state before them."""
    fade = np.array([r.decay for r in rules]) ** n
    seeded = np.array([r.seeded for r in rules])
    later = np.where(seeded, local + fade * (before - first), local + fade * before)
    return np.where(n == 0, before, np.where(np.isnan(before), local, later))


def _fold_boundaries(told: Sequence[dict], rules: Sequence[Recurrence]) -> list[tuple]:
    """Per partition that goes on with the key before it: part and, as lists, what its rows take in."""
    out, before = [], None
    empty = np.where([r.seeded for r in rules], np.nan, 0.0)
    for part in sorted(told, key=lambda b: b["part"]):
        arrays = {k: np.array(part[k], float) for k in ("x_segment", "x_run", "state", "count", "entered", "after", "whole")}
        leaves = {"key": part["last"], "segment": part["last_segment"], **{k: arrays[k] for k in ("state", "count", "entered", "whole")}}
        if before is not None and before["key"] == part["first"]:
            goes_on = before["segment"] == part["first_segment"]
            state = before["state"] if goes_on else empty
            count = before["count"] if goes_on else np.zeros(len(rules))
            entered = before["entered"] if goes_on else before["whole"]
            out.append((part["part"], *(x.tolist() for x in (
                state, count, entered, before["whole"], arrays["x_segment"], arrays["x_run"]))))
            if part["one_run"]:
                leaves["whole"] = _joined(
                    arrays["whole"], np.array(part["total"], float), before["whole"], arrays["x_run"], rules)
                if part["one_segment"]:
                    leaves["state"] = _joined(arrays["state"], arrays["count"], state, arrays["x_segment"], rules)
                    leaves["count"], leaves["entered"] = arrays["count"] + count, entered
                else:
                    leaves["entered"] = _joined(arrays["entered"], arrays["after"], before["whole"], arrays["x_run"], rules)
        before = leaves
    return out


def decayed_scan(
    df: DataFrame,
    *,
    entity: Sequence[str],
    order: Sequence[str],
    values: dict[str, Recurrence],
    restart: Sequence[str] = (),
    parts: int | None = None,
    told: tuple[Sequence[str], Callable[[dict[str, np.ndarray]], Sequence[np.ndarray]]] | None = None,
) -> DataFrame:
    """State of a null-skipping linear recurrence *before* every row.

    Rows of an entity go by ``restart`` and then ``order``, nulls first; a
    change of a ``restart`` column resets the state.  ``order`` should end in a unique key and carry
    whatever the caller needs to join back on: the rows cross one exchange.
    Null entities are one entity.  Only one boundary row a partition reaches the driver.

    Output: entity, restart and order columns, the raw values, and per value ``v``
    ``v__s`` (state before the row; NULL before any observation when seeded),
    ``v__n`` (observations before the row) and, with ``restart``,
    ``v__e`` (state of the never-reset recurrence when the segment began).  With ``told`` (names of columns, and
    their arrays of the tables x, state, count and entered: rows x values, NaN where absent) these stand
    in place of the values and their states, and no others are written.
    """
    spark = df.sparkSession
    ship_package(spark)
    lead = list(dict.fromkeys([*entity, *restart, *order]))
    names, rules = list(values), list(values.values())
    slim = df.select(*[F.col(f"`{c}`") for c in lead if c not in values], *[F.col(f"`{v}`").cast("double") for v in names])
    lead = [c for c in lead if c not in values]
    width, tables = len(names), ("state", "count", "entered", "entered_after") if restart else ("state", "count")
    shown, make = told or _everything(names, bool(restart))
    columns = slim.columns if told is None else lead
    told_fields = [T.StructField(c, T.DoubleType()) for c in shown]
    lists = [f"__{k}" for k in (*tables, "x")[:None if told else -1]]
    final = T.StructType([T.StructField(c, slim.schema[c].dataType) for c in columns] + told_fields)
    schema = T.StructType([*final.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in lists],
                           T.StructField("__part", T.LongType()), T.StructField("__zone", T.IntegerType()), T.StructField("__told", T.StringType())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, part, kinds_of = _Stream(entity, restart, values), TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds_of = batch.schema
            out = stream.read(batch)
            n, late = batch.num_rows, out["zone"] > 0
            # the rows of the partition's first entity keep their states until it is known what comes in
            ends = pa.array(np.concatenate([[0], np.cumsum(late * width)]).astype(np.int32), mask=np.append(~late, False))
            yield pa.record_batch(
                [*(batch[c] for c in columns), *(pa.array(a, pa.float64(), mask=late | np.isnan(a)) for a in make(out)),
                 *(pa.ListArray.from_arrays(ends, pa.array(out[c[2:]][late].ravel())) for c in lists),
                 pa.array(np.full(n, part)), pa.array(out["zone"], pa.int32()), pa.nulls(n, pa.string())], names=schema.names)
        if kinds_of is not None:
            end = json.dumps(stream.boundary() | {"part": part})
            yield pa.record_batch(
                [*(pa.nulls(1, kinds_of.field(c).type) for c in columns), *(pa.nulls(1, pa.float64()) for _ in shown),
                 *(pa.nulls(1, pa.list_(pa.float64())) for _ in lists),
                 pa.array([part], pa.int64()), pa.array([0], pa.int32()), pa.array([end])], names=schema.names)

    local = materialize(sorted_ranges(slim, [*entity, *restart, *[c for c in order if c not in values]], parts)
                        .mapInArrow(scan, schema), "scan")
    ends = [json.loads(r[0]) for r in local.where(F.col("__told").isNotNull()).select("__told").collect()]
    carried = {part: [np.array(x, float) for x in taken] for part, *taken in _fold_boundaries(ends, rules)}

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {c[2:]: batch[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy() for c in lists}
            zone, parts_of = batch["__zone"].to_numpy(), batch["__part"].to_numpy()
            for part in np.unique(parts_of).tolist():
                if part in carried:
                    _take_in(out, parts_of == part, zone, carried[part], rules)
            yield pa.record_batch([*(batch[c] for c in columns), *(pa.array(a, pa.float64(), mask=np.isnan(a)) for a in make(out))],
                                  names=final.names)

    rows = local.where(F.col("__told").isNull())
    late = rows.where("__zone > 0").select(*[F.col(f"`{c}`") for c in columns], *lists, "__part", "__zone")
    settled = rows.where("__zone = 0").select(*[F.col(f"`{c}`") for c in final.names])
    return settled.unionByName(late.mapInArrow(finish, final))


def _everything(names: Sequence[str], restarts: bool) -> tuple[list[str], Callable]:
    """All states, value by value."""
    kinds = {"s": "state", "n": "count", "e": "entered"} if restarts else {"s": "state", "n": "count"}
    return ([f"{v}__{k}" for k in kinds for v in names],
            lambda tables: [column for k in kinds.values() for column in tables[k].T])


def _take_in(tables: dict[str, np.ndarray], of_part: np.ndarray, zone: np.ndarray, taken: Sequence[np.ndarray],
             rules: Sequence[Recurrence]) -> None:
    """Rows of a partition's first entity take in what the partitions before it leave."""
    state, count, entered, whole, x_segment, x_run = taken
    first, later = of_part & (zone == 1), of_part & (zone == 2)
    tables["state"][first] = _joined(tables["state"][first], tables["count"][first], state, x_segment, rules)
    tables["count"][first] += count
    if "entered" in tables:
        tables["entered"][first] = entered
        tables["entered"][later] = _joined(tables["entered"][later], tables["entered_after"][later], whole, x_run, rules)


def state_after(v: str, rule: Recurrence) -> Column:
    """A scan's state once the row itself is folded in."""
    x, s = F.col(v), F.col(f"{v}__s")
    return F.when(x.isNull(), s).when(s.isNull(), x).otherwise(rule.decay * s + rule.gain * x)


def bias_corrected_mean(v: str, alpha: float) -> Column:
    """Exponentially weighted mean with weights (1-alpha)^k normalised by their sum."""
    n, b = F.col(f"{v}__n"), 1.0 - alpha
    return F.when(n > 0, F.col(f"{v}__s") * alpha / (1.0 - F.pow(F.lit(b), n)))


# --------------------------------------------------------------------------
# prior-only baseline
# --------------------------------------------------------------------------


def prior_baseline(
    df: DataFrame, stats: Sequence[str], season: str = "season", by: Sequence[str] = ()
) -> DataFrame:
    """Mean of each statistic over strictly earlier seasons, one row per season.

    The first season a statistic has data falls back to its own mean.  The
    window runs over the season-level aggregate only.
    """
    totals = df.groupBy(*by, season).agg(
        *[F.expr(f"sum(`{s}`) AS `{s}__t`") for s in stats], *[F.expr(f"count(`{s}`) AS `{s}__n`") for s in stats]
    )
    part = f"PARTITION BY {_names(by)} " if by else ""
    past = f"OVER ({part}ORDER BY `{season}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return totals.selectExpr(*[f"`{c}`" for c in (*by, season)], *[
        f"CASE WHEN coalesce(sum(`{s}__n`) {past}, 0) > 0 "
        f"THEN coalesce(sum(`{s}__t`) {past}, 0.0D) / sum(`{s}__n`) {past} "
        f"WHEN `{s}__n` > 0 THEN `{s}__t` / `{s}__n` END AS `{s}`" for s in stats
    ])


def center(
    df: DataFrame, stats: Sequence[str], season: str = "season", by: Sequence[str] = (), scale=None
) -> DataFrame:
    """Subtract the prior-only baseline (and divide by a fixed scale).

    The baseline is written first, so the join is planned on its real size
    (a row per season broadcasts by itself) and rows never shuffle by season.
    """
    keys = [*by, season]
    base = materialize(prior_baseline(df, stats, season, by), "baseline")
    base = base.selectExpr(*[f"`{k}`" for k in keys], *[f"`{s}` AS `{s}__b`" for s in stats])
    scale = scale or {}
    return df.join(base, keys, "left").selectExpr(
        *[f"`{c}`" for c in df.columns if c not in stats],
        *[f"(`{s}` - `{s}__b`) / {float(scale.get(s, 1.0))!r}D AS `{s}`" for s in stats],
    )


# --------------------------------------------------------------------------
# strict as-of join
# --------------------------------------------------------------------------


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    key: Sequence[str],
    clock: str,
    values: Sequence[str],
    parts: int | None = None,
) -> DataFrame:
    """For each left row the latest right row with a strictly earlier clock.

    ``right`` must hold one row per (key, clock).  The two sides are stacked and sorted over
    all partitions by (key, clock); each partition carries the last right row along and
    hands its last one to the partitions after it.  Left rows with a null key
    or clock have no match and cross no shuffle; right rows with one are nobody's match.
    """
    spark = left.sparkSession
    ship_package(spark)
    cols = left.columns
    row = T.StructType(left.schema.fields)
    payload = T.StructType([right.schema[v] for v in values])
    whole = lambda df: F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*key, clock]))
    keys = [f"__key{i}" for i in range(len(key))]
    named = [F.col(f"`{k}`").alias(n) for k, n in zip(key, keys)]
    stacked = left.where(whole(left)).select(
        *named, F.col(f"`{clock}`").alias("__clock"), F.lit(0).alias("__side"),
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.lit(None).cast(payload).alias("__v"),
    ).unionByName(right.where(whole(right)).select(
        *named, F.col(f"`{clock}`").alias("__clock"), F.lit(1).alias("__side"), F.lit(None).cast(row).alias("__row"),
        F.struct(*[F.col(f"`{v}`") for v in values]).alias("__v")))
    schema = T.StructType([
        T.StructField("__row", row), T.StructField("__v", payload), T.StructField("__part", T.LongType()),
        T.StructField("__open", T.BooleanType()), T.StructField("__first", T.StringType()), T.StructField("__last", T.StringType())])

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, owner, first, runs, held, last = TaskContext.get().partitionId(), None, None, 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            last = batch
            begins, after = _changes(batch, keys, owner)
            if owner is None:
                first, held = tuple(batch[k][0].as_py() for k in keys), pa.nulls(1, batch["__v"].type)
            owner = after
            right_row = batch["__side"].to_numpy() == 1
            latest = np.maximum.accumulate(np.where(right_row, np.arange(n), -1))
            start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))  # -1: the run of the batch before
            at = np.where(latest >= np.maximum(start, 0), latest + 1, np.where(start < 0, 0, -1))
            pool = pa.concat_arrays([held, batch["__v"]])
            found = pool.take(pa.array(at, pa.int64(), mask=at < 0))
            of_first = runs + np.cumsum(begins) == 1
            runs += int(begins.sum())
            held = found.slice(n - 1, 1)
            keep = pa.array(~right_row)
            seen = found.filter(keep)
            m = len(seen)
            open_ = of_first[~right_row] & seen.is_null().to_numpy(zero_copy_only=False).astype(bool)
            yield pa.record_batch([batch["__row"].filter(keep), seen, pa.array(np.full(m, part)), pa.array(open_),
                                   pa.nulls(m, pa.string()), pa.nulls(m, pa.string())], names=schema.names)
        if last is not None:
            yield pa.record_batch([pa.nulls(1, last["__row"].type), held, pa.array([part], pa.int64()), pa.array([False]),
                                   pa.array([repr(first)]), pa.array([repr(owner)])], names=schema.names)

    local = materialize(sorted_ranges(stacked, [*keys, "__clock", "__side"], parts).mapInArrow(carry, schema), "as-of")
    rows = local.where(F.col("__last").isNull())
    # one row a partition: what the partitions before it leave to its first key
    ends = local.where(F.col("__last").isNotNull())
    steps = ends.select("__part", F.lit(0).alias("__kind"), F.col("__first").alias("__key"), F.lit(None).cast(payload).alias("__v")).unionByName(
        ends.select("__part", F.lit(1).alias("__kind"), F.col("__last").alias("__key"), "__v"))
    past = W.partitionBy("__key").orderBy("__part", "__kind").rowsBetween(W.unboundedPreceding, -1)
    handed = steps.withColumn("__handed", F.last("__v", ignorenulls=True).over(past)).where("__kind = 0").select("__part", "__handed")
    shown = lambda hit: [F.col("__row.*"), *[F.col(f"{hit}.`{v}`").alias(v) for v in values]]
    settled = rows.where(~F.col("__open")).select(*shown("__v"))
    late = rows.where("__open").join(handed, "__part", "left").select(*shown("__handed"))
    without = left.where(~whole(left)).select("*", *[F.lit(None).cast(payload[v].dataType).alias(v) for v in values])
    return settled.unionByName(late).unionByName(without)


def latest_per_clock(df: DataFrame, key: Sequence[str], clock: str, order: Sequence[str],
                     values: Sequence[str]) -> DataFrame:
    """Reduce to one row per (key, clock): the last one in ``order``."""
    pick = F.max_by(F.struct(*values), F.struct(*order)).alias("__v")
    return df.groupBy(*key, clock).agg(pick).select(*key, clock, "__v.*")


# --------------------------------------------------------------------------
# expanding history: see also histories.py
# --------------------------------------------------------------------------


def prefix_totals(rows: DataFrame, clock: str, aggs: dict[str, Column]) -> DataFrame:
    """Sums over all strictly earlier clock values, one row per clock value.

    Rows are reduced to one line per clock value before the running window,
    which therefore sees only as many rows as there are clock values.
    """
    per = rows.groupBy(clock).agg(*[c.alias(n) for n, c in aggs.items()])
    past = W.orderBy(clock).rowsBetween(W.unboundedPreceding, -1)
    return per.select(clock, *[F.coalesce(F.sum(n).over(past), F.lit(0)).alias(n) for n in aggs])
