"""Expanding histories against plain loops; sketches within their error."""

import random

import pytest
from pyspark.sql import functions as F

from foreslate.operators import histories as H


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(3)
    # two thirds of the rows share one clock; some clocks and values are null
    rows = [(7 if rng.random() < 0.66 else rng.choice([None, *range(20)]), rng.choice([None, *range(300)])) for _ in range(4000)]
    cuts = [3, 7, 8, 8, None, 15, -5, 40]
    frame = spark.createDataFrame(rows, "clock int, x int").repartition(6)
    x = F.col("x")
    out = H.expanding_states(frame, spark.createDataFrame([(c,) for c in cuts], "cut int"), "clock", "cut", {
        "n": H.counted(F.lit(True)), "sum": H.total(x), "lo": H.least(x), "hi": H.greatest(x),
        "kinds": H.distinct_about(x), "mid": H.quantile_about(x, 0.5)})
    return rows, cuts, {r.cut: r for r in out.collect()}


def test_against_loops(told):
    rows, cuts, out = told
    assert sorted(out) == sorted({c for c in cuts if c is not None})
    for cut, r in out.items():
        past = [x for t, x in rows if t is not None and t < cut]
        seen = sorted(x for x in past if x is not None)
        assert (r.n, r.sum, r.lo, r.hi) == (len(past), *((sum(seen), seen[0], seen[-1]) if seen else (None,) * 3))
        assert r.kinds == pytest.approx(len(set(seen)), rel=0.05)
        if seen:
            assert sum(x < r.mid for x in seen) / len(seen) <= 0.54 and sum(x <= r.mid for x in seen) / len(seen) >= 0.46
        else:
            assert r.mid is None


def test_rows_are_one_line_a_clock_value(spark, monkeypatch):
    held, joined = [], H.asof_backward
    monkeypatch.setattr(H, "asof_backward", lambda left, right, **how: held.append((left, right)) or joined(left, right, **how))
    rows, cuts = spark.range(3000).selectExpr("id % 10 AS clock"), spark.range(100).selectExpr("id % 4 * 3 AS cut")
    out = H.expanding_states(rows, cuts, "clock", "cut", {"n": H.counted(F.lit(True))})
    assert {r.cut: r.n for r in out.collect()} == {0: 0, 3: 900, 6: 1800, 9: 2700}
    assert [df.count() for df in held[0]] == [10, 4]


def test_empty_tables(spark):
    rows, cuts = spark.createDataFrame([], "clock int, x int"), spark.createDataFrame([(4,)], "cut int")
    states = {"n": H.counted(F.lit(True)), "s": H.total(F.col("x")), "d": H.distinct_about(F.col("x"))}
    assert [tuple(r) for r in H.expanding_states(rows, cuts, "clock", "cut", states).collect()] == [(4, 0, None, 0)]
    assert H.expanding_states(rows, cuts.where("false"), "clock", "cut", states).count() == 0
