"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

1. A window has as many words as an item. Every window that shares a shingle with an item of that length gets
   a 64-bit SimHash of its weighted shingles, as each item does. (The others have similarity 0 to all items.)
2. Fingerprints meet by blocks of 8 bits: of two within RADIUS = 23 bits, one of 8 blocks differs in at
   most 2, so the items are indexed under all 37 values near each of their blocks, and no pair within the
   radius is missed. Windows only meet items of their own length.
3. Candidates within the radius are verified by the weighted Jaccard similarity of their distinct
   shingles. A shingle weighs its number of characters.

A pair of similarity 0.8 differs in about 10 bits, with a standard deviation of 3.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS, WIDTH, RADIUS = 8, 8, 23
#: Shingles in all windows that one row is expanded to.
CUT = 1 << 14
#: Bytes of a table of items, as unsafe rows, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def _with_shingles(df: DataFrame, w: str, k: int) -> DataFrame:
    """df with h: hashes of all runs of k words in the array w; each word is hashed once."""
    run = ", ".join(f"hashes[i + {j}]" for j in range(k))
    return df.withColumn("hashes", F.transform(w, lambda x: F.xxhash64(x))).withColumn("h", F.expr(f"IF(size(hashes) < {k}, array(), transform(sequence(0, size(hashes) - {k}), i -> xxhash64({run})))"))


def _weighted(w: str, k: str, distinct: bool = True) -> str:
    """Shingles as numbers: 48 bits of a hash, and below them the weight in 16 bits."""
    one = f"(xxhash64(slice({w}, i, {k})) & -65536) | least(65535, length(array_join(slice({w}, i, {k}), ' ')))"
    each = f"transform(sequence(1, size({w}) - {k} + 1), i -> {one})"
    return f"IF(size({w}) < {k} OR {k} = 0, cast(array() AS array<bigint>), {f'array_distinct({each})' if distinct else each})"


#: Four bits as four lanes of 16 bits, for sums of weights of four bits at once.
_LANES = "array(" + ", ".join(f"{sum(1 << 16 * i for i in range(4) if n >> i & 1)}L" for n in range(16)) + ")"


def _simhash(f: str) -> str:
    """The bits for which shingles of more than half of all weight have a 1. Lanes hold sums below 32,768; beyond it each bit is summed alone."""
    hashed = f"transform({f}, x -> struct(xxhash64(x) AS h, x & 65535 AS w))"
    lanes = f"transform(sequence(0, 15), g -> aggregate(s.f, 0L, (acc, x) -> acc + element_at({_LANES}, cast(1 + (shiftrightunsigned(x.h, 4 * g) & 15) AS int)) * x.w))"
    quick = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(2 * (shiftrightunsigned(element_at(l, cast(1 + b DIV 4 AS int)), 16 * (b % 4)) & 65535) > s.total, shiftleft(1L, b), 0L))"
    plain = "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(2 * aggregate(s.f, 0L, (a, x) -> a + IF(shiftright(x.h, b) & 1 = 1, x.w, 0L)) > s.total, shiftleft(1L, b), 0L))"
    return f"element_at(transform(array(struct({hashed} AS f, {_weight(f)} AS total)), s -> IF(s.total < 32768, element_at(transform(array({lanes}), l -> {quick}), 1), {plain})), 1)"


def _weight(f: str) -> str:
    return f"aggregate({f}, 0L, (acc, x) -> acc + (x & 65535))"


def _blocks(fingerprint: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b AS block, cast(shiftright({fingerprint}, b * {WIDTH}) & 255 AS int) AS bits))")


def _near_masks() -> Column:
    masks = [sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), n)]
    return F.array(*map(F.lit, masks))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_words, m (words), k (words of a shingle), f (weighted shingles), item_fp; items without a word are left out."""
    own = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("item_words")).withColumn("m", F.size("item_words")).where("m > 0")
    own = own.withColumn("k", F.least(F.lit(SHINGLE), F.col("m"))).withColumn("f", F.expr(_weighted("item_words", "k")))
    return own.withColumn("item_fp", F.expr(_simhash("f")))


def _maybe_broadcast(df: DataFrame, row_bytes: str) -> DataFrame:
    """df, broadcast if its rows take no more than BROADCAST_BYTES; row_bytes: SQL for the bytes of a row."""
    held = df.agg(F.sum(F.expr(row_bytes))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), length (words), similarity, windows: the best window of each document and item that are alike.

    Documents without one have no row. Null and empty texts, and items without a word, are never alike. An
    item of fewer than five words is one shingle of all its words. Repeated rows, which have equal doc_id
    and text, give one row; equal doc_ids with different texts are told apart by text_hash. A null doc_id
    is -1. Extra columns are ignored. No rows or no items: no rows.
    """
    named = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = staged(items(benchmark), "items")
    widths = sorted(r["k"] for r in known.select("k").distinct().collect())  # five at most
    own_shingles = [_with_shingles(known.where(F.col("k") == k).select("k", "m", "item_words"), "item_words", k).select("k", "m", F.explode("h").alias("h")) for k in widths]
    if not own_shingles:
        return _nothing(docs)
    placed = _maybe_broadcast(staged(reduce(DataFrame.union, own_shingles).distinct(), "shingles"), "48")
    hits = None
    for k in widths:
        split = named.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
        each = _with_shingles(split, "w", k).select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode_outer("h").alias("pos", "h"))  # outer, as the filter that an inner one infers would do all hashing again
        own = each.join(placed.where(F.col("k") == k), "h").select("doc_id", "text_hash", "n", "k", "m", "pos")
        hits = own if hits is None else hits.union(own)
    # The windows of m words that hold the shingle at pos, in a text of n words, begin in a range; a shorter text is one window.
    spans = hits.select("doc_id", "text_hash", "m", F.expr("greatest(0, pos - m + k)").alias("lo"), F.expr("greatest(0, least(pos, n - m))").alias("hi")).distinct()
    in_order = Window.partitionBy("doc_id", "text_hash", "m").orderBy("lo", "hi")
    apart = F.coalesce((F.col("lo") > F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1))
    ranges = spans.withColumn("apart", apart).withColumn("run", F.sum("apart").over(in_order)).groupBy("doc_id", "text_hash", "m", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Ranges are cut so that the windows of each cut hold CUT shingles at most.
    step = F.expr(f"greatest(1, {CUT} div m)")
    cuts = ranges.withColumn("step", step).select("doc_id", "text_hash", "m", "hi", "step", F.explode(F.expr("sequence(lo, hi, step)")).alias("lo")).select("doc_id", "text_hash", F.struct("m", "lo", F.least("hi", F.col("lo") + F.col("step") - 1).alias("hi")).alias("cut"))
    per_document = staged(cuts.groupBy("doc_id", "text_hash").agg(F.collect_list("cut").alias("cuts")), "windows")
    # A merge join at every size: the texts that hold windows may be as many as all.
    held = named.join(per_document.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    keyed = held.select("doc_id", "text_hash", "cuts", words(F.col("text")).alias("w")).withColumn("keys", F.expr(_weighted("w", str(SHINGLE), distinct=False)))
    own_part = F.expr(f"explode(transform(cuts, x -> struct(x.m AS m, x.lo AS lo, x.hi AS hi, IF(x.m < {SHINGLE}, slice(w, x.lo + 1, x.hi - x.lo + x.m), cast(array() AS array<string>)) AS w, IF(x.m < {SHINGLE}, cast(array() AS array<bigint>), slice(keys, x.lo + 1, greatest(0, x.hi - x.lo + x.m - {SHINGLE - 1}))) AS keys))) AS x")
    parts = keyed.select("doc_id", "text_hash", own_part).select("doc_id", "text_hash", "x.*")
    short = _weighted("slice(w, o + 1, m)", "m")
    each_f = F.expr(f"explode(transform(sequence(0, hi - lo), o -> struct(lo + o AS start, IF(m < {SHINGLE}, {short}, array_distinct(slice(keys, o + 1, greatest(0, m - {SHINGLE - 1})))) AS f))) AS x")
    window = parts.select("doc_id", "text_hash", "m", each_f).select("doc_id", "text_hash", "m", "x.start", "x.f")
    window = staged(window.withColumn("fp", F.expr(_simhash("f"))), "fingerprints")
    near = known.select("item_id", "m", "item_fp", F.explode(_blocks("item_fp")).alias("b")).select("item_id", "m", "item_fp", "b.block", "b.bits", F.explode(_near_masks()).alias("mask"))
    index = _maybe_broadcast(staged(near.select("item_id", "m", "item_fp", "block", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits")), "index"), "56")
    probes = window.select("doc_id", "text_hash", "m", "start", "fp", F.explode(_blocks("fp")).alias("b")).select("doc_id", "text_hash", "m", "start", "fp", "b.block", "b.bits")
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = probes.join(index, ["m", "block", "bits"]).where(within).select("doc_id", "text_hash", "m", "start", "item_id").distinct()
    item_f = _maybe_broadcast(known.select("item_id", F.col("f").alias("item_f")), "64 + 8 * size(item_f)")
    both = pairs.join(window.drop("fp"), ["doc_id", "text_hash", "m", "start"]).join(item_f, "item_id")
    similarity = F.col("shared") / (F.expr(_weight("f")) + F.expr(_weight("item_f")) - F.col("shared"))
    alike = both.withColumn("shared", F.expr(_weight("array_intersect(f, item_f)"))).withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m"))
    return alike.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"), F.count("*").alias("windows")).select("doc_id", "text_hash", "item_id", (-F.col("best.s")).alias("start"), F.col("best.m").alias("length"), F.col("best.similarity").alias("similarity"), "windows")


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, length int, similarity double, windows long")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item, repeated ones too, with all columns, whatever their names.

    Null and empty texts stay; a null doc_id counts as -1 and stays null. No items: all rows. No rows: no rows.
    """
    own_id, own_hash = (free_name(n, *docs.columns) for n in ("contaminated_id", "contaminated_hash"))
    bad = staged(contamination(docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "contaminated")
    keyed = docs.withColumns({own_id: F.coalesce("doc_id", F.lit(-1)).cast("long"), own_hash: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(bad, [own_id, own_hash], "left_anti").select(*docs.columns)
