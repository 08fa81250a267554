"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillbridge.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``edges`` (``a, b``): the least node it reaches.

    Each round a node takes the least label among its neighbours, and then the label of that
    label, so a chain shrinks by half and more. Rounds are written, and end when nothing
    changes. A node with very many neighbours is met by partial aggregates and joins on a
    unique side only. Loops and repeated edges are harmless; no edges give no nodes.
    """
    loops = edges.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    both = edges.select("a", "b").union(edges.select("b", "a")).union(loops.select("a", F.col("a").alias("b")))
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), "labels")
    while True:
        # a node is its own neighbour, so the least label is never above its own
        near = both.join(labels.withColumnRenamed("node", "b"), "b")
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old")
        stepped = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("next"), own)
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = stepped.join(jump, "next").select("node", F.least("next", "far").alias("comp"), "old")
        new = written(new, "labels")
        labels = new.select("node", "comp")
        if new.filter(F.col("comp") < F.col("old")).isEmpty():
            return labels
