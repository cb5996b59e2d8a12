"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored, temporary
from .skew import join_unique

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b); the label is the least node that it reaches.

    Each round takes the least label of the neighbours and then that label's own
    label, so rounds grow with the logarithm of the longest path.  Rounds end in
    written tables; the driver only sees how many labels changed.
    """
    with temporary(edges.sparkSession) as made:
        return made.keep(_settled(edges), "labels")


def _settled(edges: DataFrame) -> DataFrame:
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    # n: the neighbours of a node, by which hubs are kept apart in the joins
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "m").alias("label"), "n"), "labels")
    for _ in range(MAX_ROUNDS):
        near = join_unique(both, labels.select(F.col("node").alias("b"), "label", "n"), ["b"], F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = stored(labels.join(near, "node").select("node", "label", "n", F.least("label", "near").alias("new")), "near")
        # a label that many nodes have is asked for once
        asked = new.groupBy("new").agg(F.count(F.lit(1)).alias("asked"))
        jump = stored(labels.select(F.col("node").alias("new"), F.col("label").alias("further")).join(asked, "new"), "jump")
        new = join_unique(new, jump, ["new"], F.col("node"), weight="asked")
        new = stored(new.select("node", F.least("new", "further").alias("label"), "n", (F.least("new", "further") != F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels.select("node", "label")
    raise RuntimeError("labels didn't settle")
