"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in ``edges`` (a, b); component is the smallest id reached.

    Labels spread over the edges and then jump to their label's label, until
    none changes; each round is written to the shared folder, and only the
    number of changes is gathered.  No edges give no rows.
    """
    both = materialize(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
        .distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component"))
                         .withColumn("changed", F.lit(True)), "labels")
    while labels.where("changed").limit(1).count():
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        target = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        labels = materialize(
            spread.join(target, "next").select(
                "id", F.least("next", "jump").alias("component"),
                (F.least("next", "jump") < F.col("component")).alias("changed")), "labels")
    return labels.select("id", "component")
