"""Places in a total order of a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import written

#: Bits below which an increasing id counts the rows of its task.
_ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str = "place", *, parts: int | None = None) -> DataFrame:
    """df with its rows' places from 1 in an order: ranges of the order are sorted task by task, and each range's first place is a prefix sum.

    Rows that the order can't tell apart stand in any order, and in one range: give a total one. One number for each range goes
    through the driver. Without rows: no rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = "_at"
    while at in df.columns:
        at += "_"
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, _ROW_BITS).cast("int")
    first, firsts = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        firsts.append((r["part"], first))
        first += r["count"]
    starts = spark.createDataFrame(firsts, "_part int, _first long")
    placed = rows.join(F.broadcast(starts), part == F.col("_part"))
    return placed.withColumn(name, F.col("_first") + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).drop(at, "_part", "_first")
