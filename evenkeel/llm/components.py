"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import Tables, written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``: the label is one node of its component.

    Each round, every node hooks to its smallest neighbour, labels are replaced by their hooks and links inside one
    label are dropped, so rounds grow with the logarithm of the component. Hot nodes are reduced map-side.
    """
    pairs = links.select("a", "b").where("a <> b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    made = Tables(links.sparkSession)
    graph = made.written(both, "links")
    labels = graph.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while not graph.isEmpty():
        hooks = made.written(graph.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")), "hooks")
        # a chain of hooks is followed two steps at once
        far = hooks.alias("x").join(hooks.alias("y"), F.col("x.up") == F.col("y.a"), "left")
        hooks = made.written(far.select("x.a", F.coalesce("y.up", "x.up").alias("up")), "hooks")
        up = hooks.select(F.col("a").alias("label"), "up")
        labels = made.written(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        ends = graph.join(hooks, "a").select(F.col("up").alias("a"), "b")
        ends = ends.join(hooks.select(F.col("a").alias("b"), F.col("up").alias("to")), "b").select("a", F.col("to").alias("b"))
        graph = made.written(ends.where("a <> b").distinct(), "links")
    labels = written(labels, "labels")
    made.remove()
    return labels
