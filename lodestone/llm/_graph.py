"""Connected components in Spark: every round hooks a vertex to its least neighbour and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import sized, written

#: Rounds whose moves one plan puts together.
CHAINED = 4


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of edges (a, b), 64-bit; label: one vertex of its component, the same for all.

    Only tables in the shared folder are kept between rounds; no link or label reaches the driver.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while rows := edges.count():
        edges = sized(edges, rows)
        both = sized(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), rows)
        hooks = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to")), "hooks")
        hooks = sized(hooks, rows)
        moved = hooks.select(F.col("v").alias("label"), "to")
        labels = hooks.select("v", F.col("to").alias("label")) if labels is None else labels.join(moved, "label", "left").select("v", F.coalesce("to", "label").alias("label"))
        left, right = hooks.toDF("a", "x"), hooks.toDF("b", "y")
        edges = written(edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
        if turn % CHAINED == 0:
            labels = written(labels, "labels")
    return edges.sparkSession.createDataFrame([], "v long, label long") if labels is None else written(labels, "labels")
