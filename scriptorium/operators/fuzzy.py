"""Exact best matches by difflib's ratio, by a walk through the titles' letters with a bar for each name.

A ratio is 2 M / (|a| + |b|), and M, the letters of matching blocks, is at most the length of the longest common
subsequence. Each name's bar is the ratio of the last of its best few among texts that share its rarest three-letter
runs. Titles are dealt out in blocks by range; a task puts a block's titles together letter by letter, equal beginnings
once, and leaves a beginning for a name as soon as no title below can reach the bar. What is left is scored from the
best bound down, until the best few are certain.

Names that don't fit a machine word go by an index of letter counts, as `candidates` does for all: M is at most the
number of letters that both texts have, each as often as the rarer side has it. A text is therefore a set of (letter,
n-th time) marks: to reach a ratio r two texts need at least r / 2 (|a| + |b|) marks in common, so that they share one
of the first |a| - o + 1 marks, and one of the first |b| - o + 1, in any order; the rare come first.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.staging import written

#: Rarest runs of a name, and catalogue rows of a run, among which its bar is found.
RUNS, ROWS = 6, 64
#: What rounding to four places can add to a bar.
_SLACK = 1e-4
#: Letters of a name that is looked for in blocks of titles; a longer one goes by the letter index.
LETTERS = 62
#: Titles of a block, names that meet a block in a task, names looked for at once, and beginnings that one step makes.
TITLES, NAMES, TOGETHER, STEP = 1 << 17, 1 << 14, 128, 1 << 20
#: Letters by which the end is chosen from which titles are read.
END = 5


def sorted_words(c: Column) -> Column:
    """All words of a text in order, repeated ones as often as they occur."""
    return F.array_join(F.sort_array(T.key_tokens(c, ())), " ")


def marks(words: Column) -> Column:
    """(letter, n-th time) of every letter, as text."""
    letters = F.array_distinct(F.filter(F.split(words, ""), lambda x: x != ""))
    times = lambda x: F.length(words) - F.length(F.replace(words, x, F.lit("")))
    return F.flatten(F.transform(letters, lambda x: F.transform(F.sequence(F.lit(1), times(x)), lambda i: F.concat(x, i.cast("string")))))


def ratios(pairs: DataFrame, *, exact: bool = False) -> DataFrame:
    """pairs with score: 100 times the ratio of x to y, to four places; the ratio itself if exact."""

    @F.pandas_udf(DoubleType())
    def ratio(xs: pd.Series, ys: pd.Series) -> pd.Series:
        matcher, last, out = difflib.SequenceMatcher(None), None, []
        for x, y in zip(xs, ys, strict=True):
            if y != last:
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            out.append(matcher.ratio() if exact else round(100.0 * matcher.ratio(), 4))
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("score", ratio("x", "y"))


def _share(bar: Column) -> Column:
    """The least part of a text's letters that a text of any length must share to reach a bar."""
    return bar / (200 - bar)


def _beside(x: DataFrame, y: DataFrame, c: Column, n: int) -> DataFrame:
    """a, b: up to 2 n titles beside each name in alphabetical order of c(text), among the rows of a batch."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ids = batch["own"].to_numpy(zero_copy_only=False), batch["id"].to_numpy()
            titles, names = np.flatnonzero(~own), np.flatnonzero(own)
            at = np.searchsorted(titles, names)[:, None] + np.arange(-n, n)
            ok = (at >= 0) & (at < len(titles))
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.repeat(names, ok.sum(axis=1))]), pa.array(ids[titles[at[ok]]])], ["a", "b"])

    rows = x.select(c(F.col("x")).alias("t"), F.col("a").alias("id"), F.lit(True).alias("own")).union(y.select(c(F.col("y")), "b", F.lit(False)))
    ranges = 2 * x.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionByRange(ranges, "t").sortWithinPartitions("t").mapInArrow(pairs, "a long, b long")


def _bars(x: DataFrame, y: DataFrame, least: float, top: int) -> DataFrame:
    """a, bar: the top-th best score that a few likely rows give, those with equal runs or beside the name; `least` where they are fewer."""
    runs = lambda rows, own, c: rows.select(own, F.length(c).alias(f"n{own}"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(3))))).alias("run"))
    right = runs(y, "b", "y")
    common = right.groupBy("run").agg(F.count("*").alias("df"))
    few = right.withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("nb", "b"))).where(F.col("i") <= ROWS).drop("i")
    rare = runs(x, "a", "x").join(common, "run").withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("df", "run"))).where(F.col("i") <= RUNS)
    met = rare.select("a", "na", "run").join(few, "run").groupBy("a", "na", "b", "nb").agg(F.count("*").alias("n"))
    likely = met.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), F.abs(F.col("na") - F.col("nb")), "b"))).where(F.col("i") <= 4 * top).select("a", "b")
    pairs = likely.union(_beside(x, y, lambda c: c, top)).union(_beside(x, y, F.reverse, top)).distinct()
    scored = ratios(written(pairs.join(x, "a").join(y, "b"), "likely")).withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("i") == top)
    return scored.select("a", F.greatest(F.col("score"), F.lit(least)).alias("bar"))


def candidates(x: DataFrame, y: DataFrame, bars: DataFrame, least: float) -> DataFrame:
    """a, x, b, y of the pairs whose letters allow a's bar: all that reach it, and others."""
    own = x.join(bars, "a", "left").withColumn("bar", F.coalesce("bar", F.lit(least)) - _SLACK).withColumn("m", marks(F.col("x")))
    other = y.withColumn("m", marks(F.col("y")))
    each_y = written(other.select("b", F.length("y").alias("nb"), F.explode("m").alias("mark")), "marks")
    known = written(each_y.groupBy("mark").agg(F.count("*").alias("df")), "frequency")
    placed = lambda each, name: each.join(known, "mark", "left").withColumn("place", F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "mark")))
    short_x = placed(own.select("a", F.length("x").alias("na"), "bar", F.explode("m").alias("mark")), "a").where("df is not null").where(F.col("place") <= F.col("na") - F.ceil(_share(F.col("bar")) * F.col("na") - 1e-9) + 1)
    short_y = placed(each_y, "b").where(F.col("place") <= F.col("nb") - F.ceil(_share(F.lit(least - _SLACK)) * F.col("nb") - 1e-9) + 1)
    needed = F.col("bar") / 200 * (F.col("na") + F.col("nb"))
    met = written(short_x.select("a", "na", "bar", "mark"), "left").join(written(short_y.select("b", "nb", "mark"), "right").hint("merge"), "mark")
    pairs = met.where(F.least("na", "nb") >= needed).select("a", "b", "bar").distinct()
    texts = pairs.join(own.select("a", "x", F.col("m").alias("ma")).hint("merge"), "a").join(other.select("b", "y", F.col("m").alias("mb")).hint("merge"), "b")
    return texts.where(F.size(F.array_intersect("ma", "mb")) >= F.col("bar") / 200 * (F.length("x") + F.length("y"))).select("a", "x", "b", "y")


class _Level(NamedTuple):
    """The different beginnings of some length: last letter, shortest and longest title below, the title that is that long (-1: none), and the beginnings one letter longer."""

    letter: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    n: np.ndarray


def _levels(titles: list[str]) -> tuple[np.ndarray, list[_Level]]:
    """Letters in use, and the beginnings of sorted, different, non-empty titles from no letter on."""
    size = np.array([len(t) for t in titles])
    width = int(size.max())
    alphabet, letters = np.unique(np.array(titles, dtype=f"U{width}").view(np.uint32), return_inverse=True)
    letters = letters.reshape(len(titles), width)
    place = np.zeros(len(titles), dtype=np.int64)
    zero = np.zeros(1, dtype=np.int64)
    levels = [_Level(zero, size.min(keepdims=True), size.max(keepdims=True), zero - 1, zero, zero)]
    other = np.zeros(len(titles), dtype=bool)
    other[0] = True
    for d in range(width):
        other[1:] |= letters[1:, d] != letters[:-1, d]
        rows = np.flatnonzero(size > d)
        starts = np.flatnonzero(other[rows])
        parents = place[rows[starts]]
        n = np.bincount(parents, minlength=len(levels[-1].letter))
        levels[-1] = levels[-1]._replace(first=np.cumsum(n) - n, n=n)
        place[rows] = np.cumsum(other[rows]) - 1
        ends = np.full(len(starts), -1)
        done = rows[size[rows] == d + 1]
        ends[place[done]] = done
        least, most = np.minimum.reduceat(size[rows], starts), np.maximum.reduceat(size[rows], starts)
        levels.append(_Level(letters[rows[starts], d], least, most, ends, zero, zero))
    levels[-1] = levels[-1]._replace(first=np.zeros_like(levels[-1].ends), n=np.zeros_like(levels[-1].ends))
    return alphabet, levels


def _reaching(names: list[str], bars: np.ndarray, alphabet: np.ndarray, levels: list[_Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, title and length of the longest common subsequence of all pairs whose ratio that length lets reach the name's bar."""
    size = np.array([len(x) for x in names])
    at = np.zeros((len(names), len(alphabet)), dtype=np.uint64)
    of = {chr(c): i for i, c in enumerate(alphabet)}
    for i, x in enumerate(names):
        for j, c in enumerate(x):
            if c in of:
                at[i, of[c]] |= np.uint64(1 << j)
    below = np.array([(1 << j) - 1 for j in range(LETTERS + 1)], dtype=np.uint64)
    # a zero at bit j: the subsequence with the name's first j + 1 letters is longer by one than with the first j
    open_ = [(0, np.arange(len(names)), np.zeros(len(names), dtype=np.int64), np.full(len(names), ~np.uint64(0)))]
    found = []
    while open_:
        d, who, node, v = open_.pop()
        n = levels[d].n[node]
        if n.sum() > STEP and len(node) > 1:
            half = len(node) // 2
            open_ += [(d, who[:half], node[:half], v[:half]), (d, who[half:], node[half:], v[half:])]
            continue
        each = np.repeat(np.arange(len(node)), n)
        child = levels[d].first[node][each] + np.arange(len(each)) - (np.cumsum(n) - n)[each]
        who, v, level = who[each], v[each], levels[d + 1]
        both = v & at[who, level.letter[child]]
        v = (v + both) | (v - both)
        after, long = level.longest[child] - d - 1, size[who]
        most = np.bitwise_count(~v & below[np.maximum(long - after, 0)]) + np.minimum(long, after)
        keep = np.flatnonzero(200 * most >= bars[who] * (long + level.shortest[child]))
        who, child, v = who[keep], child[keep], v[keep]
        end = np.flatnonzero(level.ends[child] >= 0)
        common = np.bitwise_count(~v[end] & below[size[who[end]]]).astype(np.int64)
        end, common = (z[200 * common >= bars[who[end]] * (size[who[end]] + d + 1)] for z in (end, common))
        found.append((who[end], level.ends[child[end]], common))
        if len(child) and d + 2 < len(levels):
            open_.append((d + 1, who, child, v))
    who, title, common = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.argsort(who, kind="stable")
    return who[order], title[order], common[order]


def _first(x: str, near: list[tuple[str, list, int]], least: float, top: int) -> list[tuple]:
    """(entity, score) of the top entities among titles with their entities and the length of the longest common subsequence, best bound first."""
    place = lambda e: (e is not None, e)
    bound = {k: round(100.0 * (2.0 * k[0] / k[1]), 4) for k in {(n, len(x) + len(y)) for y, _, n in near}}
    ranked, matcher = [], difflib.SequenceMatcher(None)
    matcher.set_seq1(x)
    for b, first, y, entities in sorted(((-bound[n, len(x) + len(y)], place(es[0]), y, es) for y, es, n in near), key=lambda r: r[:3]):
        if len(ranked) == top and ranked[-1][:2] <= (b, first):
            break
        matcher.set_seq2(y)
        score = round(100.0 * matcher.ratio(), 4)
        if score >= least:
            best = {e: s for s, _, e in ranked}
            best |= {e: min(-score, best.get(e, 0)) for e in entities}
            ranked = sorted(((s, place(e), e) for e, s in best.items()), key=lambda r: r[:2])[:top]
    return [(e, -s) for s, _, e in ranked]


def _searched(x: DataFrame, y: DataFrame, least: float, top: int) -> DataFrame:
    """x, e, score: of each block of titles (y, es: entities in order) the first top entities for each name (x, bar)."""
    cores = x.sparkSession.sparkContext.defaultParallelism
    n_x, n_y, ahead, behind = (*x.agg(F.count("*")).first(), *y.agg(F.count("*"), F.approx_count_distinct(F.substring("y", 1, END)), F.approx_count_distinct(F.substring(F.reverse("y"), 1, END))).first())
    back = behind < ahead
    read = F.reverse if back else F.col
    blocks = max(1, -(-n_y // TITLES))
    parts = max(1, -(-n_x // NAMES), min(-(-4 * cores // blocks), -(-n_x // TOGETHER)))
    dealt = written(y.select(read("y").alias("y"), "es").repartitionByRange(blocks, "y").withColumn("block", F.spark_partition_id()), "blocks")
    own = x.select(read("x").alias("x"), "bar", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("part"))
    cell = (F.col("part") * blocks + F.col("block")).alias("cell")
    left = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(cell, "x", "bar").repartition(2 * parts * blocks, "cell")
    right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(cell, "y", "es").repartition(2 * parts * blocks, "cell")
    turned = (lambda t: t[::-1]) if back else (lambda t: t)

    def search(names: pa.Table, titles: pa.Table) -> pa.Table:
        out = []
        if names.num_rows and titles.num_rows:
            titles = titles.sort_by("y")
            ys, es = titles["y"].to_pylist(), titles["es"].to_pylist()
            alphabet, levels = _levels(ys)
            for start in range(0, names.num_rows, TOGETHER):
                some = names.slice(start, TOGETHER)
                xs = some["x"].to_pylist()
                who, title, common = _reaching(xs, some["bar"].to_numpy() - _SLACK, alphabet, levels)
                to = np.searchsorted(who, np.arange(len(xs) + 1))
                for i, name in enumerate(xs):
                    near = [(turned(ys[t]), es[t], n) for t, n in zip(title[to[i] : to[i + 1]].tolist(), common[to[i] : to[i + 1]].tolist(), strict=True)]
                    out += [(turned(name), e, s) for e, s in _first(turned(name), near, least, top)]
        kind = titles.schema.field("es").type.value_type
        return pa.table({"x": pa.array([r[0] for r in out], pa.string()), "e": pa.array([r[1] for r in out], kind), "score": pa.array([r[2] for r in out], pa.float64())})

    schema = StructType([StructField("x", x.schema["x"].dataType), StructField("e", y.schema["es"].dataType.elementType), StructField("score", DoubleType())])
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, schema)


def best_matches(left: DataFrame, key: str, name: str, catalogue: DataFrame, entity: str, title: str, *, least: float = 60, top: int = 5) -> DataFrame:
    """key, entity, score, nth: up to `top` catalogue rows for each key whose sorted words are alike to at least `least` of 100.

    The same as scoring every pair, ties to the least entity; only pairs whose bound can reach the best few are scored.
    Names and titles without words are like none. Equal texts are compared once, and of a title's entities the first `top` count, since no
    other can be among a name's best; a key or entity with several texts has its best. Null ids count as ids; null texts have no words. least must be above 0.
    """
    words = lambda rows, own, c, ids, out: rows.select(F.col(own).alias(ids), sorted_words(F.col(c)).alias(out)).where(F.col(out) != "").distinct()
    of_left, of_right = written(words(left, key, name, "k", "x"), "names"), written(words(catalogue, entity, title, "e", "y"), "titles")
    number = lambda df, c, to: df.select(F.xxhash64(c, F.reverse(c)).alias(to), c).distinct()
    x, y = written(number(of_left, "x", "a"), "left_texts"), written(number(of_right, "y", "b"), "right_texts")
    in_order = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    few = of_right.withColumn("i", in_order("y", F.asc_nulls_first("e"))).where(F.col("i") <= top)
    # arrays of structs are sorted by place, and a list keeps null entities only inside them
    titles = written(few.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("es")).select("y", F.transform("es", lambda r: r["e"]).alias("es")), "entities")
    bars = written(_bars(x, y, least, top), "bars")
    known = written(x.join(bars, "a", "left").select("a", "x", F.coalesce("bar", F.lit(float(least))).alias("bar")), "names_with_bars")
    fits = F.length("x") <= LETTERS
    # a title so long that no name of LETTERS letters is like it
    longest = int(LETTERS * (200 / (least - _SLACK) - 1)) + 1
    by_text = _searched(known.where(fits), titles.where(F.length("y") <= longest), least, top)
    if known.where(~fits).limit(1).count():
        scored = ratios(written(candidates(known.where(~fits).select("a", "x"), y, bars, least), "candidates")).where(F.col("score") >= least)
        by_text = by_text.unionByName(scored.select("x", "y", "score").join(titles.hint("merge"), "y").select("x", F.explode("es").alias("e"), "score"))
    each = written(by_text, "scored").groupBy("x", "e").agg(F.max("score").alias("score"))
    best = written(each.withColumn("i", in_order("x", F.desc("score"), F.asc_nulls_first("e"))).where(F.col("i") <= top).drop("i"), "best")
    both = of_left.join(best.hint("merge"), "x").groupBy(F.col("k").alias(key), F.col("e").alias("entity")).agg(F.max("score").alias("score"))
    return both.withColumn("nth", in_order(key, F.desc("score"), F.asc_nulls_first("entity"))).where(F.col("nth") <= top)
