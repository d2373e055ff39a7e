"""Decisions that are taken one after another in an order, as rounds over tables.

What doesn't depend on anything undecided is decided at once, round by round; when few rows are left, one task decides
them in order. So rounds only run while there are many rows, and each takes all that the order allows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import written
from . import fuzzy

#: Rows that one task decides in order.
FEW = 100_000


def first_come(candidates: DataFrame, key: str, entity: str, order: str, preference: str, *, few: int = FEW) -> DataFrame:
    """key, entity: each key in ascending order takes the entity that it prefers among those that no earlier key has taken.

    candidates: one row for each key and entity that may go together, with the key's place in order (one for each key; equal ones: the least
    key first) and the entity's preference, the least first (equal ones: the least entity). Null keys or entities never match. Up to `few`
    rows one task goes through in order. Beyond that, all keys ask at once for what they prefer; an entity goes to the earliest that has asked for
    it, even if it was with a later one, and who loses asks on, past entities that an earlier key holds. When nobody asks any
    more, everyone has what the order gives. Rounds grow with the longest chain of keys that push one another on. No rows: no rows.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(preference, entity))
    given = candidates.where(F.col(key).isNotNull() & F.col(entity).isNotNull()).select(key, entity, order, preference)
    rows = written(given.select(key, entity, order, nth.alias("_n")), "candidates")

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        out, keys, entities = [], set(), set()
        for r in pdf.sort_values([order, key, "_n"], kind="stable")[[key, entity]].itertuples(index=False):
            if r[0] not in keys and r[1] not in entities:
                keys.add(r[0])
                entities.add(r[1])
                out.append(r)
        return pd.DataFrame(out, columns=[key, entity])

    if rows.limit(few + 1).count() <= few:
        return rows.groupBy(F.lit(1).alias("_all")).applyInPandas(in_order, rows.select(key, entity).schema)
    who = F.struct(order, key)
    held = rows.limit(0).select(entity, who.alias("_who"), "_n")
    asking = written(rows.groupBy(key).agg(F.lit(0).alias("_from")), "asking")
    while asking.limit(1).count():
        further = rows.join(asking, key).where(F.col("_n") > F.col("_from"))
        free = further.join(held.select(entity, F.col("_who").alias("_held")), entity, "left").where(F.col("_held").isNull() | (who < F.col("_held")))
        asked = free.groupBy(key).agg(F.min_by(F.struct(entity, who.alias("_who"), "_n"), "_n").alias("a")).select(f"a.{entity}", "a._who", "a._n")
        claims = written(held.unionByName(asked), "claims")
        held = written(claims.groupBy(entity).agg(F.min(F.struct("_who", "_n")).alias("w")).select(entity, "w._who", "w._n"), "held")
        lost = claims.join(held.select(entity, F.col("_who").alias("_held")), entity).where(F.col("_who") != F.col("_held"))
        asking = written(lost.select(F.col("_who")[key].alias(key), F.col("_n").alias("_from")), "asking")
    return held.select(F.col("_who")[key].alias(key), entity)


def leaders(terms: DataFrame, order: str, term: str, least: float = 0.88, *, few: int = FEW) -> DataFrame:
    """Rows of terms that are kept: in ascending order, a term stays unless it is like one that has stayed, to at least `least` by difflib's ratio of both without case.

    order is one for each row. Pairs that are that alike come from the letter index, not from all pairs; in a round, a term
    without an undecided earlier like one is decided. Null terms are left out; of equal ones the first counts.
    """
    rows = written(terms.where(F.col(term).isNotNull()).select(F.col(order).alias("o"), T.casefold(F.col(term)).alias("x")), "terms")
    own = written(rows.groupBy("x").agg(F.min("o").alias("o")), "texts")
    x, y = own.where("x != ''").select(F.col("o").alias("a"), "x"), own.where("x != ''").select(F.col("o").alias("b"), F.col("x").alias("y"))
    none = own.select(F.col("o").alias("a"), F.lit(None).cast("double").alias("bar")).limit(0)
    near = fuzzy.ratios(fuzzy.candidates(x, y, none, 100 * least).where("b < a"), exact=True).where(F.col("score") >= least)
    links = written(near.select("a", "b"), "links")
    kept = own.join(links.select(F.col("a").alias("o")), "o", "left_anti").select("o")
    parts = [written(kept, "kept")]
    while links.limit(few + 1).count() > few:
        dropped = written(links.join(parts[-1].select(F.col("o").alias("b")), "b", "left_semi").select("a").distinct(), "dropped")
        open_ = links.join(dropped, "a", "left_anti")
        later = written(open_.join(dropped.select(F.col("a").alias("b")), "b", "left_anti"), "links")
        now = open_.select("a").distinct().join(later.select("a"), "a", "left_anti").select(F.col("a").alias("o"))
        parts.append(written(now, "kept"))
        links = later

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        """kept holds the terms that are decided already."""
        stay, out = set(pdf.loc[pdf["b"].isna(), "a"]), []
        for a, own in pdf[pdf["b"].notna()].sort_values("a").groupby("a", sort=True):
            if not stay.intersection(own["b"]):
                stay.add(a)
                out.append(a)
        return pd.DataFrame({"o": out})

    kept_ends = links.select(F.col("b").alias("o")).distinct()
    known = parts[0].select("o")
    for p in parts[1:]:
        known = known.union(p)
    decided = kept_ends.join(known, "o", "left_semi").select(F.col("o").alias("a"), F.lit(None).cast(links.schema["b"].dataType).alias("b"))
    rest = links.unionByName(decided).groupBy(F.lit(1).alias("_all")).applyInPandas(in_order, own.select("o").schema)
    all_kept = known.union(rest)
    return terms.join(all_kept.withColumnRenamed("o", order), order, "left_semi")
