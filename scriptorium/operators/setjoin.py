"""Exact best matches between sets of words: prefix filter, length bounds, verification.

Words are ordered from rare to frequent among the right sets. If two sets share at least o words, they share one of
the first |x| - o + 1 of the one and one of the first |y| - o + 1 of the other: so frequent words, which most sets
hold, hardly ever join. Sets of few words take them along, so that the join itself counts the words in common and no
pair below the bar is written or shuffled. Rounds go from a high bar to none; a key whose best match reaches a round's bar is
settled there, and only the others go on, at last, or as soon as they are few, by all their words: parts of the left sets meet blocks of the right ones,
both of bounded size, and a task counts a set's words in common with a block, so that no pair is shuffled but the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..functions.staging import written

#: Bars of the rounds before the last, which has none.
BARS = (0.5, 0.2)
#: What rounding to four places can hide.
_ROUNDING = 1e-4
#: Words and sets of a block of right sets, words of a part of left ones.
WORDS, SETS, PART = 1 << 21, 1 << 14, 1 << 21
#: Words of a set that goes along with each word of its prefix.
SHORT = 64
#: Pairs of a left set that is still open and a right one, up to which all are counted in blocks rather than by another round.
COUNTED = 1 << 34


def _placed(each: DataFrame, own: str, frequency: DataFrame) -> DataFrame:
    """own, n, word, place: words that the right side has, with their place from rare to frequent among all words of the row."""
    order = Window.partitionBy(own).orderBy(F.coalesce("df", F.lit(0)), "word")
    placed = each.join(frequency.hint("merge"), "word", "left").select(own, "n", "word", F.row_number().over(order).alias("place"), "df")
    return placed.where("df is not null").drop("df")


def _least(n: Column, bar: float) -> Column:
    """The least number of shared words at a bar."""
    return F.ceil(n * F.lit(bar) - 1e-9)


def _prefixes(x: DataFrame, y: DataFrame, key: str, bar: float, jaccard: bool) -> tuple[DataFrame, DataFrame]:
    """key, n_left, word and entity, n_right, word: the words by which pairs at the bar must meet."""
    within = lambda rows: rows.where(F.col("place") <= F.col("n") - _least(F.col("n"), bar) + 1)
    return within(x).select(key, F.col("n").alias("n_left"), "word"), (within(y) if jaccard else y).select("entity", F.col("n").alias("n_right"), "word")


def _of_length(met: DataFrame, bar: float, jaccard: bool) -> DataFrame:
    met = met.where(F.col("n_right") >= _least(F.col("n_left"), bar))
    return met.where(F.col("n_left") >= _least(F.col("n_right"), bar)) if jaccard else met


def candidates(x: DataFrame, y: DataFrame, key: str, bar: float, jaccard: bool) -> DataFrame:
    """key, entity, n_left, n_right of pairs whose prefixes meet and whose lengths allow the bar. No pair at or above the bar is missing."""
    a, b = _prefixes(x, y, key, bar, jaccard)
    return _of_length(a.join(b, "word"), bar, jaccard).select(key, "entity", "n_left", "n_right").distinct()


def near_short(x: DataFrame, y: DataFrame, a: DataFrame, b: DataFrame, key: str, bar: float, jaccard: bool) -> DataFrame:
    """key, entity, n_left, n_right, shared of all pairs at the bar of sets (key, t) and (entity, t) of up to SHORT words; the join counts, no other pair leaves it."""
    left, right = _prefixes(x.where(F.col("n") <= SHORT), y.where(F.col("n") <= SHORT), key, bar, jaccard)
    left = left.join(a.select(key, F.col("t").alias("t_left")).hint("merge"), key)
    right = right.join(b.select("entity", F.col("t").alias("t_right")).hint("merge"), "entity")
    met = _of_length(left.join(right, "word"), bar, jaccard)
    counted = met.select(key, "entity", "n_left", "n_right", F.size(F.array_intersect("t_left", "t_right")).cast("long").alias("shared"))
    return counted.where(similarity(jaccard) >= bar).distinct()


def verified(pairs: DataFrame, x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """key, entity, n_left, n_right, shared of candidate pairs: their words are joined one by one, so that no row holds a set."""
    own = pairs.join(x.select(key, "word").hint("merge"), key)
    return own.join(y.select("entity", "word").hint("merge"), ["entity", "word"]).groupBy(key, "entity", "n_left", "n_right").agg(F.count("*").alias("shared"))


def similarity(jaccard: bool) -> Column:
    shared = F.col("shared")
    return shared / (F.col("n_left") + F.col("n_right") - shared) if jaccard else shared / F.col("n_left")


def _best(shared: np.ndarray, n_left: int, n_right: np.ndarray, jaccard: bool) -> np.ndarray:
    """Places of the best by the number of shared words, with what rounding can hide; of equal ones the first two."""
    hit = np.flatnonzero(shared)
    if not len(hit):
        return hit
    value = shared[hit] / (n_left + n_right[hit] - shared[hit]) if jaccard else shared[hit]
    near = value >= value.max() - (_ROUNDING if jaccard else 0)
    hit, value = hit[near], value[near]
    order = np.argsort(value, kind="stable")
    third = np.zeros(len(order), dtype=bool)
    third[2:] = value[order[2:]] == value[order[:-2]]
    return np.sort(hit[order[~third]])


class _Block:
    """A block of right sets (entity.own, t) and, for each of its words, the sets that hold it."""

    def __init__(self, y: pa.Table):
        self.entity = y["entity"].combine_chunks()
        order = pc.sort_indices(pc.struct_field(self.entity, "own"), null_placement="at_start")
        self.entity, t = self.entity.take(order), y["t"].combine_chunks().take(order)
        self.size = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(t).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        self.holders = np.repeat(np.arange(len(t)), self.size)[np.argsort(word, kind="stable")]
        self.df = np.bincount(word, minlength=len(self.words))
        self.start = np.cumsum(self.df) - self.df

    def best(self, x: pa.Table | pa.RecordBatch, key: str, jaccard: bool) -> pa.Table:
        """key, entity, shared, n_left, n_right: the best sets of the block for each left set (key, t)."""
        found_x, found_y, shared, n_left = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        known = pc.fill_null(pc.index_in(pc.list_flatten(x["t"]), value_set=self.words), -1).to_numpy()
        ends = np.cumsum(pc.list_value_length(x["t"]).to_numpy(zero_copy_only=False).astype(np.int64))
        for i, (end, n) in enumerate(zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)):
            own = known[end - n : end]
            own = own[own >= 0]
            many = self.df[own]
            met = self.holders[np.repeat(self.start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            common = np.bincount(met, minlength=len(self.size))
            best = _best(common, n, self.size, jaccard)
            found_x.append(np.full(len(best), i))
            found_y.append(best)
            shared.append(common[best])
            n_left.append(np.full(len(best), n))
        left, right = np.concatenate(found_x), np.concatenate(found_y)
        numbers = [pa.array(c.astype(np.int64)) for c in (np.concatenate(shared), np.concatenate(n_left), self.size[right])]
        return pa.Table.from_arrays([x[key].take(pa.array(left)), self.entity.take(pa.array(right)), *numbers], names=[key, "entity", "shared", "n_left", "n_right"])


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as f:
        f.write_table(table)
    return out.getvalue().to_pybytes()


def by_all_words(a: DataFrame, b: DataFrame, key: str, jaccard: bool) -> DataFrame:
    """key, entity, shared, n_left, n_right: of each block of right sets (entity, t) the best for each left set (key, t); of equal ones the two of least entity.

    entity is a struct whose field own is the id. A right side of one block is broadcast, and the left sets stay where they are. A larger one is
    dealt out by blocks and meets every part of the left side: that is for few left sets, or for a right side of few blocks.
    """
    words = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    n_b, words_b = words(b)
    blocks = max(1, -(-words_b // WORDS), -(-n_b // SETS))
    schema = StructType([a.schema[key], b.schema["entity"], *(StructField(c, LongType()) for c in ("shared", "n_left", "n_right"))])
    if blocks == 1:
        sent = a.sparkSession.sparkContext.broadcast(_ipc(b.select("entity", "t").toArrow()))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = None
            for x in batches:
                block = block or _Block(pa.ipc.open_stream(sent.value).read_all())
                yield from block.best(x, key, jaccard).to_batches()

        return a.select(key, "t").mapInArrow(meet, schema)
    n_a, words_a = words(a)
    parts = max(1, -(-words_a // PART), min(-(-4 * a.sparkSession.sparkContext.defaultParallelism // blocks), n_a))
    some = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("part") * blocks + F.col("block")).alias("cell")
    left = a.select(key, "t", some(parts, key, "t").alias("part")).withColumn("block", each(blocks)).select(cell, key, "t").repartition(2 * parts * blocks, "cell")
    right = b.select("entity", "t", some(blocks, "entity", "t").alias("block")).withColumn("part", each(parts)).select(cell, "entity", "t").repartition(2 * parts * blocks, "cell")
    count = lambda x, y: _Block(y).best(x.combine_chunks(), key, jaccard)
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(count, schema)


def _worded(rows: DataFrame, own: str, c: str, stopwords: tuple[str, ...], least: int) -> DataFrame:
    """own, text, t, words: the different words of `least` letters or more, sorted, and a hash of them. Rows without any stay: a condition on t would be checked first, on words split once more."""
    t = F.sort_array(T.token_set(F.col("text"), stopwords, least)).alias("t")
    return rows.select(F.col(own).alias("own"), F.col(c).alias("text")).select("own", "text", t).withColumn("words", F.md5(F.array_join("t", " ")))


def _right_sets(right: DataFrame, entity: str, right_text: str, stopwords: tuple[str, ...], least: int) -> DataFrame:
    """entity, t: one row for each different set of an id; an id with several texts is several sets."""
    each = _worded(right, entity, right_text, stopwords, least).where(F.size("t") > 0)
    return each.groupBy(F.struct("own", "words").alias("entity")).agg(F.first("t").alias("t"))


def _one_round(a: DataFrame, b: DataFrame, key: str, jaccard: bool) -> DataFrame:
    """best_pairs without bars, of written sets (_x, t), which may repeat, and (entity, t): repeated ones leave as few rows and meet only then."""
    found = by_all_words(a.where(F.size("t") > 0), b, "_x", jaccard).distinct()
    return found.select(F.col("_x.own").alias(key), F.col("entity.own").alias("entity"), "shared", "n_left", "n_right")


def equal_and_best(left: DataFrame, key: str, left_text: str, right: DataFrame, entity: str, right_text: str, *, jaccard: bool = True, stopwords: tuple[str, ...] = T.STOPWORDS, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(key, entity) of rows whose text has a right one's canonical key, the least entity of that key; and best_pairs without bars of the other rows.

    Texts are split once for both: only where the words are those of some right row is the key itself made and compared.
    """
    key_of = T.canonical_key(F.col("text"), stopwords)
    names = _worded(right, entity, right_text, stopwords, least).groupBy(key_of.alias("name"), "words").agg(F.min(F.struct(F.col("own").alias("entity"))).alias("equal")).where("name != ''")
    x = _worded(left, key, left_text, stopwords, least).join(names.select("words", F.lit(True).alias("met")).distinct(), "words", "left")
    # no key begins with #: rows that need none are dealt out by their words
    x = x.withColumn("name", F.when(F.col("met"), key_of).otherwise(F.concat(F.lit("#"), "words"))).join(names.drop("words"), "name", "left")
    a = written(x.select(F.struct("own", "words").alias("_x"), F.when(F.col("equal").isNull(), F.col("t")).alias("t"), "equal"), "left_sets")
    b = written(_right_sets(right, entity, right_text, stopwords, least), "right_sets")
    return a.where("equal is not null").select(F.col("_x.own").alias(key), "equal.entity"), _one_round(a, b, key, jaccard)


def best_pairs(left: DataFrame, key: str, left_text: str, right: DataFrame, entity: str, right_text: str, *, jaccard: bool = True, bars: tuple[float, ...] = BARS, stopwords: tuple[str, ...] = T.STOPWORDS, least: int = 3) -> DataFrame:
    """key, entity, shared, n_left, n_right: for each key all pairs that may be its best by Jaccard similarity or, else, by shared words.

    Every key's best pair is among its rows, and one that ties with it, to four places of the similarity, if there is any, the least entity always; other pairs may be. Words are
    different words of `least` letters or more. Keys whose words no right row holds have no row, as have null and empty texts. Repeated
    (key, text) rows count once; a key with several texts has each one's pairs. A word that very many rows on both sides hold comes last and
    counts only in the last round, for the keys that nothing else settles. Without bars that round is the only one, which suits a small
    right side and left sets far longer than the right ones.
    """
    sets = _worded(left, key, left_text, stopwords, least).select(F.struct("own", "words").alias("_x"), "t")
    a = written(sets.groupBy("_x").agg(F.first("t").alias("t")).where(F.size("t") > 0) if bars else sets, "left_sets")
    b = written(_right_sets(right, entity, right_text, stopwords, least), "right_sets")
    if not bars:
        return _one_round(a, b, key, jaccard)
    each_b = written(b.select("entity", F.size("t").cast("long").alias("n"), F.explode("t").alias("word")), "words")
    frequency = written(each_b.groupBy("word").agg(F.count("*").alias("df")), "frequency")
    y = written(_placed(each_b, "entity", frequency), "right")
    x = written(_placed(a.select("_x", F.size("t").cast("long").alias("n"), F.explode("t").alias("word")), "_x", frequency), "left")
    n_b = b.count()
    long = a.select("t").unionAll(b.select("t")).where(F.size("t") > SHORT).limit(1).count()
    found = None
    for bar in bars:
        if found is not None and x.select("_x").distinct().count() * n_b <= COUNTED:
            break
        near = near_short(x, y, a, b, "_x", bar, jaccard)
        if long:
            pairs = candidates(x, y, "_x", bar, jaccard).where((F.col("n_left") > SHORT) | (F.col("n_right") > SHORT))
            near = near.unionByName(verified(written(pairs, "candidates"), x, y, "_x").where(similarity(jaccard) >= bar))
        near = written(near, "near")
        settled = near.where(similarity(jaccard) >= bar + _ROUNDING).select("_x").distinct()
        now = near.join(settled, "_x", "left_semi")
        found = now if found is None else found.unionByName(now)
        x = written(x.join(settled.hint("merge"), "_x", "left_anti"), "left")
    open_ = a.join(x.select("_x").distinct(), "_x", "left_semi")
    found = found.select("_x", "entity", "shared", "n_left", "n_right").unionByName(by_all_words(open_, b, "_x", jaccard))
    return found.select(F.col("_x.own").alias(key), F.col("entity.own").alias("entity"), "shared", "n_left", "n_right")
