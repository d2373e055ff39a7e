"""Connected components of an edge table by least labels and pointer jumping, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node of its component) for every node that an edge names.

    Labels stay in tables: each round takes the least label among the neighbours, then the label of that
    label, until nothing changes. Rounds grow with the logarithm of the longest path, not with the size
    of a component, and a hub's labels are reduced before the shuffle. Joins by a label that very many nodes
    have are merge joins of plain shuffles, which Spark can split. No edges: no rows.
    """
    both = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u != v").distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("v"), "component").hint("merge"), "v").groupBy("u").agg(F.min("component").alias("m"))
        least = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("component").alias("ll"))
        labels = staged(
            least.join(jump.hint("merge"), "l", "left").select("node", F.least("l", F.coalesce("ll", "l")).alias("component"), (F.least("l", F.coalesce("ll", "l")) < F.col("old")).alias("changed")),
            "labels",
        )
    return labels.select("node", "component")
