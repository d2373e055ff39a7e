"""Views of an edge table: filters, neighbourhoods, set questions, thinning, a bipartite layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.staging import written


def filtered(edges: DataFrame, *, least: float = 0, types: tuple[str, ...] | None = None, focus: DataFrame | None = None) -> DataFrame:
    out = edges.where(F.col("weight") >= least)
    if types:
        out = out.where(F.col("edge_type").isin(*types))
    if focus is not None:
        out = out.join(focus.select(F.col("node").alias("u")), "u", "left_semi").join(focus.select(F.col("node").alias("v")), "v", "left_semi")
    return out


def visible_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()


def k_hop(edges: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """node, hop: what lies within radius steps of the start nodes, directions ignored."""
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct()
    seen = start.select("node", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, radius + 1):
        nxt = both.join(frontier.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct()
        frontier = nxt.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        seen = seen.union(frontier)
    return seen


def common_neighbours(pairs: DataFrame, side: str, other: str, selected: list) -> DataFrame:
    """What all the selected nodes of one side are tied to."""
    return pairs.where(F.col(side).isin(*selected)).groupBy(other).agg(F.count_distinct(side).alias("n")).where(F.col("n") == len(set(selected))).select(other)


def non_neighbours(pairs: DataFrame, side: str, other: str, selected: list) -> DataFrame:
    """What none of the selected nodes is tied to."""
    return pairs.select(other).distinct().join(pairs.where(F.col(side).isin(*selected)).select(other), other, "left_anti")


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node"), "weight").union(edges.select("v", "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def thinned(edges: DataFrame, most: int = 300, per_node: int = 6) -> DataFrame:
    """Edges by falling weight; one is skipped only if both its ends have per_node already; at most `most` are kept.

    Greedy, so sequential, but over few edges. One that is beyond the first per_node of its u and of its v finds
    both full: an end takes all its first per_node. Of the others, each node has 2 * per_node at most, and those
    skipped lie at nodes that are full, of which there are 2 * most / per_node; so `most` are kept within 5 * most.
    Each end's first edges are cut by each task before the shuffle, so that no task sorts all edges of a hub.
    """
    near = None
    for end in ("u", "v"):
        nth = F.row_number().over(Window.partitionBy(end).orderBy(F.desc("weight"), "u", "v"))
        own = edges.select("u", "v", "weight").withColumn("_nth", nth).where(F.col("_nth") <= per_node).drop("_nth")
        near = own if near is None else near.union(own).distinct()
    bounded = near.orderBy(F.desc("weight"), "u", "v").limit(most * 5)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "u", "v"], ascending=[False, True, True])
        degree: dict = {}
        kept = []
        for row in pdf.itertuples(index=False):
            if len(kept) >= most:
                break
            if degree.get(row.u, 0) >= per_node and degree.get(row.v, 0) >= per_node:
                continue
            kept.append(row)
            for end in (row.u, row.v):
                degree[end] = degree.get(end, 0) + 1
        return pd.DataFrame(kept, columns=pdf.columns)

    return bounded.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: greedy(pdf.drop(columns="_all", errors="ignore")), bounded.schema)


def barycentre_order(pairs: DataFrame, left: str, right: str, sweeps: int = 2) -> tuple[DataFrame, DataFrame]:
    """Places of both sides of a bipartite graph: each node at the mean place of its neighbours, swept back and forth.

    Each sweep is one weighted mean by node and one ranking by ranges; no task sees all nodes. Of nodes at the same
    place the least comes first.
    """
    place = lambda df, node, value: written(ranked(df, [value, F.col(node)]).select(node, "place"), "places")
    pairs = written(pairs.select(left, right).distinct(), "pairs")
    lefts = place(pairs.select(left).distinct(), left, F.col(left))
    rights = None
    for _ in range(sweeps):
        rights = place(pairs.join(lefts, left).groupBy(right).agg(F.avg("place").alias("m")), right, F.col("m"))
        lefts = place(pairs.join(rights, right).groupBy(left).agg(F.avg("place").alias("m")), left, F.col("m"))
    return lefts, rights
