"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumist.runtime import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that links reach.

    Each round takes the least label of a node and its neighbours and then jumps to that label's own label, so the
    number of rounds is logarithmic in a component's width. Labels are written to the shared folder each round. Null ends are left out; an
    empty table has no nodes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = materialize(hop.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")), "cc-labels")
        labels = new.select("node", "comp")
        if not new.filter("old != comp").limit(1).count():
            return labels
