"""Matching names to entities: exact key, then alias, then tokens; unique winners; greedy one-to-one."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as T
from ..functions.staging import written
from . import setjoin


def waterfall(candidates: list[DataFrame], key: str) -> DataFrame:
    """Of candidate frames (key, entity, score) in order of priority, each key's first; in a frame the best score, then the least entity."""
    ranked = None
    for i, c in enumerate(candidates):
        own = c.select(key, "entity", "score", F.lit(i).alias("step"))
        ranked = own if ranked is None else ranked.union(own)
    best = F.min_by(F.struct("entity", "step", "score"), F.struct("step", -F.col("score"), "entity"))
    return ranked.groupBy(key).agg(best.alias("b")).select(key, "b.entity", "b.step", "b.score")


def by_key(left: DataFrame, key: str, left_name: str, right: DataFrame, entity: str, right_name: str) -> DataFrame:
    a = left.select(key, T.canonical_key(F.col(left_name)).alias("_name")).where("_name != ''")
    b = right.select(F.col(entity).alias("entity"), T.canonical_key(F.col(right_name)).alias("_name"))
    return a.join(b, "_name").select(key, "entity", F.lit(1.0).alias("score"))


def token_overlap(left: DataFrame, key: str, left_text: str, right: DataFrame, entity: str, right_text: str) -> DataFrame:
    """key, entity, shared, n_left, n_right: distinct tokens of three letters or more in common. Joined by token, reduced before the shuffle."""
    a = left.select(key, T.token_set(F.col(left_text)).alias("t"))
    b = right.select(F.col(entity).alias("entity"), T.token_set(F.col(right_text)).alias("t"))
    a, b = a.withColumn("n_left", F.size("t")), b.withColumn("n_right", F.size("t"))
    return a.select(key, "n_left", F.explode("t").alias("token")).join(b.select("entity", "n_right", F.explode("t").alias("token")), "token").groupBy(key, "entity", "n_left", "n_right").agg(F.count("*").alias("shared"))


def best_overlap(overlap: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Each key's entity with most shared tokens; ties go to the least entity."""
    best = F.min_by(F.struct("entity", "shared"), F.struct(-F.col("shared"), "entity"))
    return overlap.where(F.col("shared") >= least).groupBy(key).agg(best.alias("b")).select(key, "b.entity", "b.shared")


def unique_winner(overlap: DataFrame, key: str, least: int = 1) -> DataFrame:
    """As best_overlap, but a tie for the first place is no match."""
    by_shared = overlap.where(F.col("shared") >= least).groupBy(key, "shared").agg(F.count("*").alias("n"), F.min("entity").alias("entity"))
    first = F.max_by(F.struct("n", "entity", "shared"), "shared")
    return by_shared.groupBy(key).agg(first.alias("b")).where("b.n = 1").select(key, "b.entity", "b.shared")


def jaccard_best(overlap: DataFrame, key: str) -> DataFrame:
    """Each key's entity of largest Jaccard similarity, to four places; ties go to the least entity."""
    s = F.round(F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared")), 4)
    best = F.min_by(F.struct("entity", "confidence"), F.struct(-F.col("confidence"), "entity"))
    return overlap.withColumn("confidence", s).groupBy(key).agg(best.alias("b")).select(key, "b.entity", "b.confidence")


#: Letters of a run by which texts are met that hold another.
RUN = 8


def holding(parts: DataFrame, part_id: str, part: str, wholes: DataFrame, whole_id: str, whole: str) -> DataFrame:
    """part_id, whole_id of wholes that hold a part as it is; null and empty parts are held by none.

    A part is looked for by its rarest run of RUN letters (a shorter one as a whole), so that only texts with that run are compared.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    a = written(parts.where(F.length(part) > 0).select(F.col(part_id).alias("_p"), F.col(part).alias("_part"), F.least(F.length(part), F.lit(RUN)).alias("_n")), "parts")
    b = wholes.where(F.length(whole) > 0).select(F.col(whole_id).alias("_w"), F.col(whole).alias("_whole"))
    # lengths from 1 to RUN, those that some part has
    lengths = F.broadcast(a.select("_n").distinct())
    each = written(b.join(lengths, F.length("_whole") >= F.col("_n")).select("_w", "_whole", F.explode(runs(F.col("_whole"), F.col("_n"))).alias("_run")), "runs")
    often = each.groupBy("_run").agg(F.count("*").alias("_often"))
    known = a.select("_p", "_part", F.explode(runs(F.col("_part"), F.col("_n"))).alias("_run")).join(often, "_run", "left")
    rarest = known.groupBy("_p", "_part").agg(F.min_by("_run", F.struct(F.coalesce("_often", F.lit(0)), "_run")).alias("_run"))
    met = written(rarest, "rarest").join(each.hint("merge"), "_run").where(F.col("_whole").contains(F.col("_part")))
    return met.select(F.col("_p").alias(part_id), F.col("_w").alias(whole_id)).distinct()


def foreign_items(files: DataFrame, items: DataFrame) -> DataFrame:
    """id, entity, step, score: a foreign library's item (entity, path, sha, name) for each file (id, path, sha), the least entity of the first step that has one.

    0: the same path in any case; 1: a path that holds the file's name; 2: the same hash; 3: the same name; 4: the same name without ending.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.select("id", F.lower("path").alias("path"), "sha", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"))
    i = items.select("entity", F.lower("path").alias("ipath"), F.col("sha").alias("isha"), F.lower("name").alias("iname"))
    by = lambda a, b: f.join(i.where(F.col(b).isNotNull()), F.col(a) == F.col(b)).select("id", "entity", F.lit(0.0).alias("score"))
    held = holding(f.select("id", "name"), "id", "name", i, "entity", "ipath").withColumn("score", F.lit(0.0))
    return waterfall([by("path", "ipath"), held, by("sha", "isha"), by("name", "iname"), by("stem", "iname")], "id")


#: Rounds of key_or_words: titles that lack an equal key mostly have a near one, which a high bar finds by few words.
KEY_BARS = (0.7, 0.6, *setjoin.BARS)


def key_or_words(left: DataFrame, key: str, left_text: str, right: DataFrame, entity: str, right_text: str, *, bars: tuple[float, ...] = KEY_BARS) -> DataFrame:
    """key, entity, step, confidence: an equal canonical key is a match of 1.0 (step 0) whatever the words say, else the largest Jaccard similarity of words (step 1).

    Ties go to the least entity. Only keys without an equal key are compared by words.
    """
    equal = written(by_key(left, key, left_text, right, entity, right_text), "equal")
    open_ = left.join(equal.select(key).distinct(), key, "left_anti")
    near = jaccard_best(setjoin.best_pairs(open_, key, left_text, right, entity, right_text, bars=bars), key)
    steps = [equal, near.withColumnRenamed("confidence", "score")]
    return waterfall(steps, key).select(key, "entity", "step", F.col("score").alias("confidence"))


def key_or_overlap(left: DataFrame, key: str, left_text: str, right: DataFrame, entity: str, right_text: str, *, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """key, entity, step, score: an equal canonical key is a match of 1.0 (step 0), else the largest number of shared words (step 1). Ties go to the least entity. For a small right side and long left texts."""
    equal, pairs = setjoin.equal_and_best(left, key, left_text, right, entity, right_text, jaccard=False, stopwords=stopwords)
    near = best_overlap(pairs, key).select(key, "entity", F.col("shared").cast("double").alias("score"))
    return waterfall([equal.withColumn("score", F.lit(1.0)), near], key)


@F.pandas_udf(BooleanType())
def within_one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """One insertion, deletion, substitution or swap of neighbours at most."""

    def near(x: str | None, y: str | None) -> bool:
        if x is None or y is None or abs(len(x) - len(y)) > 1:
            return False
        head = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905
        rest_x, rest_y = x[head:], y[head:]
        if len(x) != len(y):
            long, short = (rest_x, rest_y) if len(x) > len(y) else (rest_y, rest_x)
            return long[1:] == short
        return rest_x[1:] == rest_y[1:] or (rest_x[:2] == rest_y[:2][::-1] and rest_x[2:] == rest_y[2:])

    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)])


def greedy_one_to_one(candidates: DataFrame, key: str, entity: str) -> DataFrame:
    """Rows (key, entity, score) so that each side occurs once: best score first, then least key and entity.

    In rounds: a pair that is first for both its sides is taken, and both leave. Each round takes at least
    the best pair of all, and all undisputed ones at once; the order gives the same pairs as one by one.
    """
    order = F.struct(-F.col("score"), F.col(key), F.col(entity))
    left, taken = written(candidates, "left"), None
    while left.limit(1).count():
        by = lambda side: left.groupBy(side).agg(F.min(order).alias(f"_{side}"))  # noqa: B023, E731
        ranked = left.join(by(key), key).join(by(entity), entity)
        now = written(ranked.where((order == F.col(f"_{key}")) & (order == F.col(f"_{entity}"))).select(key, entity, "score"), "taken")
        taken = now if taken is None else taken.union(now)
        left = written(left.join(now.select(key), key, "left_anti").join(now.select(entity), entity, "left_anti"), "left")
    return taken if taken is not None else candidates.limit(0)


def deduplicated_terms(terms: list[str], least: float = 0.88) -> list[str]:
    """Terms in order, without those too like one already kept."""
    kept: list[str] = []
    for t in terms:
        if all(difflib.SequenceMatcher(None, t.casefold(), k.casefold()).ratio() < least for k in kept):
            kept.append(t)
    return kept
