"""Lines cross one shuffle, whatever groups or joins them by order."""

from compare import SMALL
from pyspark.sql import functions as F

from foreslate.sources.fixtures import Fixture


def test_grouping_lines_by_order_takes_no_further_shuffle(spark):
    sides = Fixture(spark, SMALL).lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    plan = sides._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_forecasts_read_contests_alone(spark):
    from foreslate.catalog import REGISTRY, frames

    fx = Fixture(spark, SMALL)
    fx.games  # kept for all
    for key in ("f15_push_probability", "a23_slate_headline"):
        REGISTRY[key].build(fx)
    assert "plays" not in fx.__dict__ and "halves" not in fx.__dict__["_shared"]
    plan = REGISTRY["f15_push_probability"].build(fx)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "home_team" not in plan
    assert frames.halved(fx).count() == frames.scored(fx).count()
