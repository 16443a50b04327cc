"""Places in groups against plain windows, with a hot group, nulls, repeats and odd names."""

import pytest
from pyspark.sql import Window as W, functions as F

from foreslate.operators import ranks
from foreslate.operators.ranks import place_in_group
from foreslate.sources.store import materialize


@pytest.fixture()
def slates(spark):
    # slate 1 owns two thirds of the rows; some slates and values are null
    number = F.col("id")
    return spark.range(900).select(
        F.when(number % 3 < 2, F.lit(1)).when(number % 30 == 2, F.lit(None)).otherwise(number % 5 + 2).alias("slate"),
        F.when(number % 11 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).alias("value"),
        number.alias("game"), number.alias("part"), number.alias("row"), number.alias("g0"))


def test_places_equal_a_window(slates):
    told = place_in_group(slates, ["slate"], [("value", True), ("game", False)], "place", parts=9)
    plain = slates.withColumn("place", F.row_number().over(W.partitionBy("slate").orderBy(F.desc("value"), "game")))
    assert told.columns == plain.columns
    assert sorted(map(str, told.collect())) == sorted(map(str, plain.collect()))


def test_a_hot_group_is_split(slates, monkeypatch):
    held = []
    monkeypatch.setattr(ranks, "materialize", lambda df, name: held.append(materialize(df, name)) or held[-1])
    told = place_in_group(slates, ["slate"], [("value", False), ("game", False)], "place", parts=9)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" in plan[plan.index("Window ["):]
    sizes = held[0].where("row.slate = 1").groupBy(F.shiftright("id", 33)).count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) < 300


def test_repeats_names_and_no_rows(slates):
    twice = slates.unionByName(slates).withColumn("place", F.lit("old"))
    told = place_in_group(twice, ["slate"], [("game", False)], "place", parts=4)
    for r in told.groupBy("slate").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.max("place").alias("m")).collect():
        assert r.n == r.d == r.m
    assert place_in_group(slates.where("false"), ["slate"], [("game", False)], "place").count() == 0
    whole = place_in_group(slates, [], [("game", True)], "place", parts=5)
    assert whole.where("place != 900 - game").count() == 0
