"""Similarity of entities by the works that mention them: sparse TF-IDF or counts, cosine pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import written
from . import rowblocks


def matrix(pairs: DataFrame, row: str, col: str, weighting: str = "count", intensity: Column | None = None) -> DataFrame:
    """Sparse triples (r, c, w): count of pairs, sum of an intensity, or 1."""
    w = {"count": F.count("*").cast("double"), "binary": F.max(F.lit(1.0)), "intensity": F.sum(F.coalesce(intensity if intensity is not None else F.lit(1.0), F.lit(0.0)))}[weighting]
    return pairs.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(w.alias("w"))


#: Rows whose sums are broadcast.
BROADCAST = 1 << 20


def tf_idf(m: DataFrame) -> DataFrame:
    """tf = w over the row's sum, idf = ln((1 + rows) / (1 + rows with the column)) + 1. Sums of up to BROADCAST rows go to the entries, which then aren't shuffled by row."""
    totals = m.groupBy("r").agg(F.sum("w").alias("row_sum"))
    n = totals.agg(F.count("*").alias("n"))
    if totals.limit(BROADCAST + 1).count() <= BROADCAST:
        totals = F.broadcast(totals)
    df = m.groupBy("c").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return m.join(df, "c").join(totals, "r").crossJoin(F.broadcast(n)).select("r", "c", (F.col("w") / F.col("row_sum") * idf).alias("w"))


#: Rows of a column that one cell of a search holds on each side; a column of more rows is a grid of cells.
CELL = 512
#: Products that one row of a table of cells makes at most, unless one side alone has more; and those of one task.
ROW, TASK = 4096, 1 << 23
#: A column of up to so many rows is always searched: what it costs is bounded, and to complete pairs by it later costs more.
SEARCHED = 64
#: What rounding to six places and the order of a sum can hide.
_SLACK = 2e-6
#: Columns of an entry that sums of pairs need.
_ENTRY = ("r", "c", "w", "norm", "df")


def _cells(entries: DataFrame, own: str, other: str, cell: int) -> DataFrame:
    """Each entry of a column in all cells of its row of the grid: own and other are the names of the two coordinates."""
    parts = F.ceil(F.col("df") / cell).cast("int")
    return entries.withColumn(own, F.pmod(F.xxhash64("r"), parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1)))


def _products(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """x, y (structs of r and all columns but c and df): each pair of a left and a right entry of one column.

    A column's entries are gathered in cells of bounded size, and cells are dealt out by their least row: columns of the same
    rows come to the same task, so that sums by pairs of rows shrink before they are shuffled, however many tasks there are.
    """
    own = [c for c in left.columns if c not in ("c", "df")]
    side = lambda cells, n: cells.select("c", "_x", "_y", F.struct(F.lit(n).alias("side"), *own).alias("e"))
    x, y = _cells(left, "_x", "_y", cell), _cells(right, "_y", "_x", cell)
    if left is right:  # an entry of a column of one cell stands on both sides of it
        both = side(x.where(F.col("df") <= cell), 0).unionAll(side(x.where(F.col("df") > cell), 1)).unionAll(side(y.where(F.col("df") > cell), 2))
    else:
        both = side(x, 1).unionAll(side(y, 2))
    xs, ys = F.filter("es", lambda e: e["side"] != 2), F.filter("es", lambda e: e["side"] != 1)
    cells = both.groupBy("c", "_x", "_y").agg(F.collect_list("e").alias("es"), F.min("e.r").alias("low")).withColumn("_nx", F.size(xs)).withColumn("_ny", F.size(ys)).where("_nx > 0 AND _ny > 0")
    most = F.greatest(F.lit(1), F.floor(F.lit(ROW) / F.col("_ny"))).cast("int")
    cut = cells.withColumn("_most", most).withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_nx"), F.col("_most"))))
    rows = written(cut.withColumn("_n", F.least(F.col("_most"), F.col("_nx") - F.col("_s") + 1).cast("long") * F.col("_ny")).drop("_nx", "_ny"), "cells")
    n = rows.agg(F.sum("_n")).first()[0] or 0
    tasks = max(-(-n // TASK), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROW)), 1)
    dealt = rows.drop("_n").repartitionByRange(tasks, "low", "c", "_x", "_y", "_s")
    return dealt.select(F.explode(F.slice(xs, F.col("_s"), F.col("_most"))).alias("x"), ys.alias("ys")).select("x", F.explode("ys").alias("y"))


def cosine_pairs(m: DataFrame, *, least: float = 0.0, least_shared: int = 1, cell: int = rowblocks.AT_ONCE) -> DataFrame:
    """a < b, similarity and shared columns of rows that share at least one column: sums by pairs of blocks of rows, so that no pair is shuffled. cell: sums and products that a task holds at once. m is read several times."""
    return rowblocks.pairs(m, cell).select("a", "b", F.round(F.col("dot") / F.col("n"), 6).alias("similarity"), "shared").where((F.col("similarity") >= least) & (F.col("shared") >= least_shared))


def _met(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """a, b, raw, size, dot: sums of products over the columns that two rows share, the product of their norms, and what the one is of the other. Both sides: r, c, w, norm, df."""
    each = _products(left, right, cell).where("x.r != y.r").select(F.col("x.r").alias("a"), F.col("y.r").alias("b"), (F.col("x.w") * F.col("y.w")).alias("p"), (F.col("x.norm") * F.col("y.norm")).alias("n"))
    return each.groupBy("a", "b").agg(F.sum("p").alias("raw"), F.max("n").alias("size")).withColumn("dot", F.col("raw") / F.col("size"))


def _dots(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, more of pairs: their sums of products over the columns in left, which b may lack."""
    x = pairs.select("a", "b").join(left.select(F.col("r").alias("a"), "c", F.col("v").alias("va")).hint("merge"), "a")
    y = right.select(F.col("r").alias("b"), "c", F.col("v").alias("vb"))
    return x.join(y.hint("merge"), ["b", "c"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("more"))


def weighed(m: DataFrame) -> DataFrame:
    """r, c, w, norm, v (of length 1), df, reach: entries with, from rare to frequent columns, a bound on what this and the more frequent columns of a row can add to any similarity."""
    norms = m.groupBy("r").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    unit = written(m.where("w != 0").join(norms.hint("merge"), "r").select("r", "c", "w", "norm", (F.col("w") / F.col("norm")).alias("v")), "unit")
    columns = unit.groupBy("c").agg(F.count("*").alias("df"), F.max("v").alias("top"))
    onward = Window.partitionBy("r").orderBy(F.desc("df"), "c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return written(unit.join(columns.hint("merge"), "c").withColumn("reach", F.sum(F.col("v") * F.col("top")).over(onward)), "weighed")


def _bars(entries: DataFrame, n: int, cell: int) -> DataFrame:
    """r, bar: the n-th similarity of each row among rows that share a rare column and weigh most in it; 0 where they are fewer."""
    heavy = Window.partitionBy("c").orderBy(F.desc("v"), "r")
    rare = Window.partitionBy("r").orderBy("df", F.desc("c"))
    few = entries.withColumn("i", F.row_number().over(heavy)).where(F.col("i") <= 2 * n)
    start = entries.withColumn("i", F.row_number().over(rare)).where(F.col("i") <= 8)
    first = _met(start.select(*_ENTRY), few.select(*_ENTRY), cell)
    likely = first.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("dot"), "b"))).where(F.col("i") <= n).select("a", "b")
    known = _dots(written(likely, "likely"), entries, entries)
    return known.groupBy("a").agg(F.min("more").alias("bar"), F.count("*").alias("k")).select(F.col("a").alias("r"), F.when(F.col("k") >= n, F.col("bar")).otherwise(0.0).alias("bar"))


def top_neighbours(m: DataFrame, n: int, *, cell: int = CELL) -> DataFrame:
    """a, b, similarity, rank: the n rows most similar to each by cosine, to six places, ties by b; exact, without a table of all pairs. m: r, c, w >= 0, read several times.

    Where entries have up to SEARCHED partners in their columns on average, blocks of rows meet and the best of each pair of blocks alone
    are shuffled. Else columns of up to SEARCHED rows are always searched, and rows that share a rare column and weigh most
    in it give each row n neighbours and so a bar for its n-th similarity, and a row's most frequent columns are left out of
    the search as long as the largest weights of those columns could not lift any row over the bar. The n-th sum of a row over
    the columns searched is a bar as well: only pairs that the other columns could lift over it are kept and completed. Columns
    of more than `cell` rows are split on both sides. Rows without a weight have no neighbours; rows that share no column are
    none. No rows: no rows.
    """
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    weighing = m.where("w != 0")
    cost, count = rowblocks.products(weighing)
    if cost <= 1.1 * SEARCHED * count:
        total = rowblocks.best(weighing, n).select("a", "b", F.round(F.col("dot") / F.col("n"), 6).alias("similarity"))
        return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    entries = weighed(m)
    by_dot = Window.partitionBy("a").orderBy(F.desc("dot")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the n-th sum of each row and what comes within the rest of it
    near = lambda met: met.withColumn("nth", F.nth_value("dot", n).over(by_dot)).where(F.col("nth").isNull() | (F.col("dot") + F.col("rest") >= F.col("nth") - _SLACK))
    barred = written(entries.join(_bars(entries, n, cell).hint("merge"), "r", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)) - _SLACK), "barred")
    out = (F.col("reach") < F.col("bar")) & (F.col("df") > SEARCHED)
    searched, left_out = barred.where(~out), barred.where(out)
    rest = left_out.groupBy("r").agg(F.max("reach").alias("rest"))
    of_row = barred.groupBy("r").agg(F.first("bar").alias("bar")).join(rest.hint("merge"), "r", "left").select(F.col("r").alias("a"), "bar", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    met = _met(searched.select(*_ENTRY), entries.select(*_ENTRY), cell)
    kept = written(near(met.join(of_row.hint("merge"), "a").where("dot + rest >= bar")).select("a", "b", "raw", "size"), "near")
    weights = lambda rows: rows.select("r", "c", F.col("w").alias("v"))
    total = kept.join(_dots(kept, weights(left_out), weights(entries)), ["a", "b"], "left").select("a", "b", F.round((F.col("raw") + F.coalesce("more", F.lit(0.0))) / F.col("size"), 6).alias("similarity"))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def neighbours(pairs: DataFrame, n: int) -> DataFrame:
    """The n most similar of each row, in both directions."""
    both = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def info(m: DataFrame) -> DataFrame:
    out = m.agg(F.count_distinct("r").alias("n_rows"), F.count_distinct("c").alias("n_cols"), F.count("*").alias("nnz"))
    return out.withColumn("sparsity", F.round(1 - F.col("nnz") / (F.col("n_rows") * F.col("n_cols")), 6))
