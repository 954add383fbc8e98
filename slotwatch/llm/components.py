"""Connected components of an undirected graph, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwatch.llm.common import stage


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``[node, comp]`` for edges ``[a, b]`` of BIGINT: the smallest node that can be reached.

    A round takes the smallest label among neighbours and then the label of the label,
    so labels travel twice as far each round. Each round is written to the shared
    folder. A node with very many edges is a partial minimum in each task.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("comp")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = stage(nearer.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp")), "cc-labels")
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
