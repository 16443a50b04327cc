"""Named queries: a Spark plan, and where SQL can say the same, its DuckDB text.

Doubles are rounded to six decimals and whole numbers widened on both sides,
so results compare by value.  Averages of short decimals often sit exactly on
a rounding tie; the same small nudge on both sides (no short decimal itself)
keeps the last bit of a sum from deciding which way such a value goes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.fixtures import VIEW_SQL, Fixture, fixture
from .shared_sql import SHARED_SQL

ALL_SQL = {**VIEW_SQL, **SHARED_SQL}
NUDGE = 2.718281828e-9


def with_views(views: str, body: str) -> str:
    """Put the named views, and what they need, in front of ``body``."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for dep in ALL_SQL[name][0].split():
            need(dep)
        order.append(name)

    for v in views.split():
        need(v)
    # a recursive view names its columns and key in a third part
    ctes = ",\n".join(f"{n}{''.join(ALL_SQL[n][2:])} AS ({ALL_SQL[n][1].strip()})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Fixture], DataFrame]
    sql: str | None
    views: str
    floats: tuple[str, ...]
    ints: tuple[str, ...]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(fixture(spark, folder))
        return df.withColumns({
            **{c: F.round(F.col(c).cast("double") + NUDGE, 6) for c in self.floats},
            **{c: F.col(c).cast("long") for c in self.ints},
        })

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        fixed = [f"CAST({c} AS BIGINT) AS {c}" for c in self.ints]
        for c in self.floats:
            r = f"round(CAST({c} AS DOUBLE) + {NUDGE!r}, 6)"
            # a negative zero would hash apart from zero
            fixed.append(f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {c}")
        inner = self.sql.strip()
        body = f"SELECT * REPLACE ({', '.join(fixed)}) FROM ({inner}) AS result" if fixed else inner
        return with_views(self.views, body)


REGISTRY: dict[str, Query] = {}


def query(key: str, floats: str = "", ints: str = "", views: str = "games", sql: str | None = None):
    """Register the decorated plan builder under ``key``."""

    def register(build: Callable[[Fixture], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, build, sql, views, tuple(floats.split()), tuple(ints.split()))
        return build

    return register
