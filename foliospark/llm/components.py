"""Connected components by contraction, all on Spark: nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import Kept, Scratch, spread_join


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in edges (a, b): equal labels, same component. It reads tables of scratch.

    Each round every node points to the least of itself and its neighbours, and edges are redrawn between
    what their ends point to. Ids should be hashes: then the nodes left shrink by a constant factor a round.
    """
    kept = Kept(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = kept.frame.unionByName(kept.frame.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"), F.count("*").alias("rows"))
        parents = scratch.keep(parents.select("node", F.least("node", "up").alias("up"), "rows"), "parents")
        if labels is None:
            labels = parents.select("node", F.col("up").alias("label"))
        else:
            sizes = labels.groupBy("label").agg(F.count("*").alias("rows"))
            # Labels that have no edge left stay as they are.
            left = labels.select("label").distinct().join(parents, F.col("label") == F.col("node"), "left").select("label", F.coalesce("up", "label").alias("up"))
            labels = scratch.keep(spread_join(labels, left, "label", sizes, "node").select("node", F.col("up").alias("label")), "labels")
        # Ends with very many edges, hubs and giant components, are dealt out by the other end.
        redrawn = kept.frame
        for end, other in (("a", "b"), ("b", "a")):
            redrawn = spread_join(redrawn, parents.select(F.col("node").alias(end), F.col("up").alias(f"u{end}")), end, parents.select(F.col("node").alias(end), "rows"), other)
        redrawn = redrawn.where(F.col("ua") != F.col("ub"))
        after = Kept(redrawn.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        kept.drop()
        kept = after
        if kept.frame.isEmpty():
            kept.drop()
            return labels
