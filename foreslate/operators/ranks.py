"""Places inside groups without a window over a whole group.

Rows are sorted over all partitions by (group, order), so a group with a third of all rows lies in a
third of the partitions.  A row's place is its place within its partition's share of the group, plus the
sizes of the group's shares in the partitions before.  The only window reads one row per group and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.store import materialize


def place_in_group(df: DataFrame, group: Sequence[str | Column], order: Sequence[tuple[str | Column, bool]], name: str,
                   parts: int | None = None) -> DataFrame:
    """``df`` with a column ``name``: each row's place, from 1, in its group.

    ``order`` holds (value, descending) pairs; nulls come first where ascending and last where descending.
    Null groups are groups too.  Rows that tie in all of ``order``, repeated ones as well, get places of their
    own in any sequence.  A column called ``name`` is replaced; others keep their names, whatever these are.
    No rows give no rows.  ``parts`` fixes the number of partitions sorted into.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    keys, values = [f"g{i}" for i in range(len(group))], [f"o{i}" for i in range(len(order))]
    rows = df.select(F.struct("*").alias("row"), *[column(c).alias(k) for c, k in zip(group, keys)],
                     *[column(c).alias(v) for (c, _), v in zip(order, values)])
    sort = [F.asc_nulls_first(k) for k in keys]
    sort += [F.desc_nulls_last(v) if down else F.asc_nulls_first(v) for v, (_, down) in zip(values, order)]
    dealt = rows.repartitionByRange(*sort) if parts is None else rows.repartitionByRange(parts, *sort)
    # an id holds its partition above bit 33 and the row's number there below
    dealt = materialize(dealt.sortWithinPartitions(*sort).select("row", *keys, F.monotonically_increasing_id().alias("id")), "places")
    dealt = dealt.withColumn("part", F.shiftright("id", 33))
    shares = dealt.groupBy(*keys, "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shares = shares.select(F.col("part").alias("of"), *[F.col(k).alias(f"_{k}") for k in keys],
                           (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1).alias("base"))
    on = F.col("part") == F.col("of")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c != name]
    return dealt.join(shares, on).select(*kept, (F.col("id") - F.col("base")).alias(name))
