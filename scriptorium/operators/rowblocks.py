"""Sums of products over the columns that two rows share, by pairs of blocks of rows: no pair is written or shuffled before its sum is whole.

Entries are ranged by row into blocks, one file each. A task reads a block and, one after another, those it is to meet,
expands their common columns a bounded number of products at a time and adds them up by pairs of rows. So what lies on
disk are the entries, whatever number of pairs they make. Blocks whose ranges of columns don't overlap never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.staging import new_folder

#: Entries of a block, and the least of one that is cut for the sake of more tasks; entries beyond which a row is joined on its own.
ENTRIES, FEW, LONG = 1 << 21, 1 << 14, 1 << 21
#: Sums that a task holds at once, and products that it expands at once; more if one row or one column of a block has more.
AT_ONCE = 1 << 20
#: Blocks that one task has its own meet.
MET = 4
#: A sum this many times rarer than places for sums is sought by sorting.
_SPARSE = 16
_SPAN = 2_000_003


class _Block:
    """Entries of a file by row, and by column with the rows that hold it."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            t = pq.read_table(f, columns=["r", "c", "w"])
        r = t["r"].combine_chunks().dictionary_encode()
        ordered = pc.sort_indices(r.dictionary)
        self.names = r.dictionary.take(ordered)
        rank = np.empty(len(ordered), dtype=np.int64)
        rank[ordered.to_numpy()] = np.arange(len(ordered))
        row = rank[r.indices.to_numpy()]
        w = pc.fill_null(t["w"], 0.0).to_numpy()
        self.norm = np.sqrt(np.bincount(row, w * w, minlength=len(rank)))
        c = t["c"].combine_chunks().dictionary_encode()
        known = np.flatnonzero(c.indices.is_valid().to_numpy(zero_copy_only=False))
        known = known[np.argsort(row[known], kind="stable")]
        self.row, self.w, self.columns = row[known], w[known], c.dictionary
        self.first = np.searchsorted(self.row, np.arange(len(rank) + 1))
        self.column = pc.fill_null(c.indices, 0).to_numpy()[known].astype(np.int64)
        self.by_column = np.argsort(self.column, kind="stable")
        self.holders, self.weights = self.row[self.by_column], self.w[self.by_column]
        self.df = np.bincount(self.column, minlength=len(self.columns))
        self.start = np.cumsum(self.df) - self.df

    def partners(self, y: _Block, after: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each entry where in y its column's entries start and how many they are; after: of y, the block itself, only those of later rows."""
        if after:
            start = np.empty(len(self.row), dtype=np.int64)
            start[self.by_column] = np.arange(1, len(self.row) + 1)
            return start, (self.start + self.df)[self.column] - start
        place = pc.fill_null(pc.index_in(self.columns, value_set=y.columns), -1).to_numpy().astype(np.int64)[self.column]
        here = place >= 0
        start, many = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        start[here], many[here] = y.start[place[here]], y.df[place[here]]
        return start, many


def _sums(x: _Block, y: _Block, after: bool, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row of x, row of y, sum of products, common columns: of whole rows of x at a time."""
    start, many = x.partners(y, after)
    before = np.concatenate([[0], np.cumsum(many)])
    of_row, n_y = before[x.first], len(y.names)

    def expanded(lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        n = many[lo:hi]
        at = np.repeat(start[lo:hi] - (before[lo:hi] - before[lo]), n) + np.arange(before[hi] - before[lo])
        return np.repeat((x.row[lo:hi] - low) * n_y, n) + y.holders[at], np.repeat(x.w[lo:hi], n) * y.weights[at]

    low = 0
    while low < len(x.names):
        few = int(np.searchsorted(of_row, of_row[low] + at_once // _SPARSE, "right")) - 1
        high = min(len(x.names), max(low + 1, low + at_once // n_y, few))
        lo, hi, products = int(x.first[low]), int(x.first[high]), int(of_row[high] - of_row[low])
        cells = (high - low) * n_y
        if products and products <= at_once and products * _SPARSE < cells:
            place, p = expanded(lo, hi, low)
            pair, which, shared = np.unique(place, return_inverse=True, return_counts=True)
            yield pair // n_y + low, pair % n_y, np.bincount(which, p, minlength=len(pair)), shared
        elif products:
            dot, shared = np.zeros(cells), np.zeros(cells, dtype=np.int64)
            while lo < hi:
                end = max(lo + 1, min(hi, int(np.searchsorted(before, before[lo] + at_once, "right")) - 1))
                place, p = expanded(lo, end, low)
                dot += np.bincount(place, p, minlength=cells)
                shared += np.bincount(place, minlength=cells)
                lo = end
            pair = np.flatnonzero(shared)
            yield pair // n_y + low, pair % n_y, dot[pair], shared[pair]
        low = high


def millionths(v: np.ndarray) -> np.ndarray:
    """v rounded half up to six places, by its shortest decimal form as Spark's round does, in millionths."""
    scaled = v * 1e6
    out = np.floor(scaled + 0.5)
    half = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    if len(half):
        values, which = np.unique(v[half], return_inverse=True)
        exact = [int(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6)) for x in values.tolist()]
        out[half] = np.array(exact, dtype=np.float64)[which]
    return out.astype(np.int64)


def _first(row: np.ndarray, other: np.ndarray, value: np.ndarray, n_other: int, n: int) -> np.ndarray:
    """Places of the n best of each row (value to six places, then the other row)."""
    of_row = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    key = (of_row * _SPAN + (_SPAN // 2 - millionths(value))) * n_other + other
    order = np.argsort(key)
    row = row[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return order[nth < n]


def _split(m: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Entries of rows of up to LONG entries, those of the few longer rows if there are any, and the number of entries."""
    sizes = m.groupBy("r").agg(F.count("*").alias("n"))
    n, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= LONG:
        return m, None, n or 0
    long = F.broadcast(sizes.where(F.col("n") > LONG).select("r"))
    return m.join(long, "r", "left_anti"), m.join(long, "r", "left_semi"), n


def _placed(m: DataFrame, n: int) -> list:
    """Files of the blocks in the order of their rows, with their least and largest column."""
    spark = m.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = new_folder(spark, "blocks")
    count = max(1, -(-n // ENTRIES), min(2 * cores, -(-n // FEW)))
    m.select("r", "c", "w").where("r is not null").repartitionByRange(count, "r").write.option("maxRecordsPerFile", 0).parquet(path)
    files = spark.read.schema(m.select("r", "c", "w").schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path"))
    return files.agg(F.min("r").alias("low"), F.min("c").alias("least"), F.max("c").alias("most")).where("least is not null").orderBy("low").collect()


def _meetings(m: DataFrame, n: int, both_ways: bool) -> list[tuple[str, list[str]]]:
    """A block and those that it meets, itself among them or, unless both ways, only those of later rows besides."""
    files = _placed(m, n)
    met = [(x["path"], [y["path"] for y in (files if both_ways else files[i:]) if y["least"] <= x["most"] and x["least"] <= y["most"]]) for i, x in enumerate(files)]
    size = max(1, min(MET, sum(len(ys) for _, ys in met) // (4 * m.sparkSession.sparkContext.defaultParallelism)))
    return [(x, ys[i : i + size]) for x, ys in met for i in range(0, len(ys), size)]


def _met(m: DataFrame, n: int, both_ways: bool, best: int | None, at_once: int) -> DataFrame:
    spark = m.sparkSession
    kind = m.schema["r"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("dot", DoubleType()), StructField("n", DoubleType()), StructField("shared", LongType())])
    meetings = _meetings(m, n, both_ways)
    sent = spark.sparkContext.broadcast(meetings)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own, others = sent.value[i]
                x = _Block(own)
                for path in others:
                    y = x if path == own else _Block(path)
                    for a, b, dot, shared in _sums(x, y, path == own and not both_ways, at_once):
                        if both_ways and path == own:
                            others_only = a != b
                            a, b, dot, shared = a[others_only], b[others_only], dot[others_only], shared[others_only]
                        norm = x.norm[a] * y.norm[b]
                        if best:
                            few = _first(a, b, dot / norm, len(y.names), best)
                            a, b, dot, norm, shared = a[few], b[few], dot[few], norm[few], shared[few]
                        if len(a):
                            yield pa.RecordBatch.from_arrays([x.names.take(pa.array(a)), y.names.take(pa.array(b)), pa.array(dot), pa.array(norm), pa.array(shared)], names=schema.names)

    # an id to a partition: each is one task
    return spark.range(0, len(meetings), 1, max(1, len(meetings))).mapInArrow(meet, schema)


def _long(long: DataFrame, m: DataFrame) -> DataFrame:
    """Sums of the few long rows with all rows, each pair from the long side: a table of few rows times all, reduced before the shuffle."""
    norms = m.groupBy("r").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x, y = long.select(F.col("r").alias("a"), "c", F.col("w").alias("v")), m.select(F.col("r").alias("b"), "c", "w")
    sums = y.join(x, "c").where("a != b").groupBy("a", "b").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.count("*").alias("shared"))
    of = lambda c: norms.select(F.col("r").alias(c), F.col("norm").alias(f"n{c}"))
    return sums.join(of("a"), "a").join(of("b"), "b").select("a", "b", "dot", (F.col("na") * F.col("nb")).alias("n"), "shared")


def pairs(m: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """a < b, dot, n (product of their norms), shared: all pairs of rows of m (r, c, w) that share a column. m is read several times."""
    short, long, n = _split(m)
    found = _met(short, n, False, None, at_once)
    if long is None:
        return found
    both = _long(long, m)
    other = both.join(F.broadcast(long.select(F.col("r").alias("b")).distinct()), "b", "left_anti").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dot", "n", "shared")
    among = both.join(F.broadcast(long.select(F.col("r").alias("b")).distinct()), "b", "left_semi").where("a < b").select(*found.columns)
    return found.unionAll(other).unionAll(among)


def best(m: DataFrame, n: int, at_once: int = AT_ONCE) -> DataFrame:
    """a, b, dot, n, shared: at least the n best of each row a by dot / n to six places, ties by b, in both directions; from each pair of blocks the n best alone leave."""
    short, long, entries = _split(m)
    found = _met(short, entries, True, n, at_once)
    if long is None:
        return found
    both = _long(long, m)
    back = both.join(F.broadcast(long.select(F.col("r").alias("b")).distinct()), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"), "dot", "n", "shared")
    return found.unionAll(both).unionAll(back)


def products(m: DataFrame) -> tuple[float, int]:
    """About how many products the pairs of entries of equal columns are, both ways and each with itself (the second moment of the
    columns' frequencies, by signed sums in 65,536 buckets: within 2 % or so), and the number of entries. It says what a plan costs, no result depends on it."""
    h = F.xxhash64("c")
    signed = m.groupBy(F.pmod(h, F.lit(65536)).alias("bucket")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1).otherwise(-1)).alias("s"), F.count("*").alias("n"))
    out = signed.agg(F.sum(F.col("s").cast("double") * F.col("s")), F.sum("n")).first()
    return out[0] or 0.0, out[1] or 0
