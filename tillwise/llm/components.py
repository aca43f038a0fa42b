"""Connected components of an edge table, by labels and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Each round takes the smallest label beside each node and then the label of that label, so a path of n
    nodes takes about log n rounds. All tables are written before they are joined: a node with very many
    edges is a hot key of a join of two shuffled scans, which adaptive execution splits. Only the count of
    changed labels comes to the driver. Null ends, loops and repeated edges are ignored."""
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        beside = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("_beside"))
        lowered = written(labels.join(beside, labels["node"] == beside["a"]).select("node", F.col("root").alias("_old"), F.least("root", "_beside").alias("root")), "labels")
        target = lowered.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = written(lowered.join(target, lowered["root"] == target["_node"]).select("node", "_old", F.col("_root").alias("root")), "labels")
        if not jumped.where("root <> _old").limit(1).count():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
