"""Weighted edges: citations, bipartite graphs, name families and the combined network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def citation_edges(mentions: DataFrame, src: str, tgt: str, in_bib: Column, *, example: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """total, bib_hits, text_hits, weighted (bibliography counts twice) and, if asked for, the first three examples by order.

    Counts are reduced before the shuffle, and so are the examples: each task passes on its first three
    of a pair at most.
    """
    out = mentions.groupBy(src, tgt).agg(F.count("*").alias("total"), F.sum(in_bib.cast("int")).cast("long").alias("bib_hits"))
    out = out.withColumn("text_hits", F.col("total") - F.col("bib_hits")).withColumn("weighted", F.col("total") + F.col("bib_hits"))
    if example is None:
        return out
    nth = F.row_number().over(Window.partitionBy(src, tgt).orderBy(*order))
    first = mentions.select(src, tgt, *order, example.alias("_example")).withColumn("_nth", nth).where("_nth <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "_example"))), lambda s: s["_example"]), " | ")
    return out.join(first.groupBy(src, tgt).agg(joined.alias("examples")), [src, tgt])


def counted_edges(df: DataFrame, *keys: str, pattern: str | None = None, order: str | None = None) -> DataFrame:
    """weight = rows of each key; raw_source = the last pattern that isn't empty."""
    aggs = [F.count("*").alias("weight")]
    if pattern:
        aggs.append(F.max_by(F.nullif(pattern, F.lit("")), F.when(F.col(pattern) != "", F.col(order))).alias("raw_source"))
    return df.groupBy(*keys).agg(*aggs)


def numeric_weight(c: Column) -> Column:
    """A decimal comma is a point, what isn't a number is 0, halves go up."""
    return F.floor(F.coalesce(F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)) + 0.5).cast("long")


def bipartite(pairs: DataFrame, doc_col: str, label_col: str, weight: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, role, mentions, items) and edges (doc, label, weight)."""
    edges = pairs.groupBy(doc_col, label_col).agg(F.sum(weight).alias("weight"))
    labels = edges.groupBy(F.col(label_col).cast("string").alias("id")).agg(F.count("*").alias("mentions")).select("id", F.lit("label").alias("role"), "mentions", F.lit(0).cast("long").alias("items"))
    docs = edges.groupBy(F.col(doc_col).cast("string").alias("id")).agg(F.count("*").alias("items")).select("id", F.lit("document").alias("role"), F.lit(0).cast("long").alias("mentions"), "items")
    return labels.union(docs), edges


#: Letters of an example.
EXAMPLE = 220


def author_families(edges: DataFrame, weight: Column, *, example: Column | None = None, order: list | None = None) -> DataFrame:
    """u (cited) to v (citing) families of names with the sum of weights, self-edges left out; with example, the first that isn't empty in the order given, cut to EXAMPLE letters.

    A null weight is 0. Edges without any example have ''.
    """
    family = lambda c: T.primary_token(T.slugify(F.col(c), None))
    shown = [] if example is None else [F.struct(*order, F.nullif(example, F.lit("")).alias("_text")).alias("_example")]
    named = edges.select(family("tgt").alias("u"), family("src").alias("v"), F.coalesce(weight, F.lit(0)).alias("w"), *shown)
    totals = [F.sum("w").alias("weight")]
    if shown:
        first = F.coalesce(F.min(F.when(F.col("_example._text").isNotNull(), F.col("_example")))["_text"], F.lit(""))
        totals.append(F.when(F.length(first) > EXAMPLE, F.concat(F.left(first, F.lit(EXAMPLE)), F.lit("…"))).otherwise(first).alias("example"))
    return named.where("u != '' and v != '' and u != v").groupBy("u", "v").agg(*totals)


def label_families(hits: DataFrame, doc_col: str, label_col: str, count: Column) -> DataFrame:
    """Edges from a document's other labels to its most frequent one (ties: the first by name)."""
    own = hits.select(F.col(doc_col).alias("d"), F.col(label_col).alias("u"), count.alias("n"))
    main = own.groupBy("d").agg(F.min_by("u", F.struct(-F.col("n"), F.col("u"))).alias("v"))
    return own.join(main, "d").where("u != v").groupBy("u", "v").agg(F.sum("n").alias("weight"))


def combined_network(authors: DataFrame, chronicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, layer, in_weight, out_weight) and edges (u, v, weight, edge_type, source_type) of both kinds together."""
    both = authors.select("u", "v", "weight", F.lit("authors").alias("s")).union(chronicles.select("u", "v", "weight", F.lit("chroniken").alias("s")))
    ends = both.select(F.col("u").alias("node"), "s").union(both.select("v", "s"))
    kinds = ends.groupBy("node").agg(F.max((F.col("s") == "authors").cast("int")).alias("a"), F.max((F.col("s") == "chroniken").cast("int")).alias("c"))
    layers = kinds.select("node", F.when(F.col("a") + F.col("c") == 2, "both").when(F.col("a") == 1, "modern_author").otherwise("chron_label").alias("layer"))
    total = both.groupBy("u", "v").agg(F.sum("weight").alias("weight"), F.array_join(F.sort_array(F.collect_set("s")), ",").alias("source_type"))
    of = lambda end: layers.select(F.col("node").alias(end), F.col("layer").alias(f"l{end}"))
    kind = F.when((F.col("lu") == "modern_author") & (F.col("lv") == "modern_author"), "AA").when((F.col("lu") == "chron_label") & (F.col("lv") == "chron_label"), "CC").otherwise("AC")
    edges = total.join(of("u"), "u").join(of("v"), "v").select("u", "v", "weight", kind.alias("edge_type"), "source_type")
    flows = total.select(F.col("u").alias("node"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")).union(total.select("v", F.lit(0).cast("long"), "weight"))
    nodes = flows.groupBy("node").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight")).join(layers, "node").select("node", "layer", "in_weight", "out_weight")
    return nodes, edges
