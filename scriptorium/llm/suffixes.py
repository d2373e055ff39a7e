"""Repeated passages by a sparse suffix array: suffixes at minimiser positions, sorted, neighbours compared, matches extended.

A suffix is kept where the hash of its first SEED words is the least of WINDOW in a row; so every run of
SEED + WINDOW - 1 = 50 words holds a kept suffix, at the same place wherever the run occurs. A run lies
around its suffix in one of 26 ways: with o words to the left of the seed and 25 - o to the right of it.

1. Seeds that one document alone holds are dropped. Suffixes that agree in the seed and in all CONTEXT words
   on both sides are one from there on, with the range of their documents; so the inside of a passage that a
   third of all documents share is one row.
2. The suffixes of a seed are sorted by the words to the right and to the left, for each of the 26 ways, and
   neighbours are compared: equal ones of different documents extend the match o words to the left and
   25 - o to the right. Both sides come from the same neighbour, so a run of 50 words counts only if one other
   document holds all of it. A seed with more than HOT different contexts is split: its suffixes meet by
   the hash of all 50 words, reduced before the shuffle.
3. Words in such runs are repeated; runs that overlap or touch are one passage.

Seeds and whole contexts are compared by 64 bits, the words of other contexts by 32 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, _BASE, Words, bounded_batches, mix, plain_documents, staged, steps

SEED, WINDOW = 25, 26
LEAST = SEED + WINDOW - 1
CONTEXT = WINDOW - 1
#: Different contexts of a seed that are sorted in one task.
HOT = 256


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width], for each i with so many values; by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def seeds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of all texts' words in a row) of kept suffixes, and their seeds' hashes."""
    counts, n = w.counts(), len(w.hash)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = np.zeros(n - SEED + 1, U)
    for j in range(SEED):
        h = h * U(_BASE) + w.hash[j : n - SEED + 1 + j]
    h = mix(h)
    end = np.repeat(w.first[1:], counts)
    least = _sliding(h, WINDOW, np.minimum)
    whole = np.arange(len(least)) + LEAST <= end[: len(least)]
    least = np.where(whole, least, U(0))
    edge = np.zeros(WINDOW - 1, U)
    most = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
    at = np.flatnonzero((most == h) & (h > 0))
    return at, h[at]


def _around(w: Words, at: np.ndarray, doc: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The j-th word before each seed and after it, and whether the text has it."""
    before, after = at - j, at + SEED + j - 1
    has_left, has_right = before >= w.first[doc], after < w.first[doc + 1]
    return w.hash[np.maximum(before, 0)], has_left, w.hash[np.minimum(after, len(w.hash) - 1)], has_right


def whole_contexts(w: Words, at: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each seed and all its context, and the ways in which 50 words of the text lie around it, as bits."""
    left, right = np.zeros(len(at), U), np.zeros(len(at), U)
    n_left, n_right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for j in range(1, CONTEXT + 1):
        a, has_a, b, has_b = _around(w, at, doc, j)
        left = left * U(_BASE) + np.where(has_a, a, U(0))
        right = right * U(_BASE) + np.where(has_b, b, U(0))
        n_left += has_a
        n_right += has_b
    room = np.zeros(len(at), np.int64)
    for o in range(WINDOW):
        room |= ((n_left >= o) & (n_right >= CONTEXT - o)).astype(np.int64) << o
    return mix(mix(left ^ h) * U(_BASE) + right), room


def contexts(w: Words, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CONTEXT words before (nearest first) and after each seed as 32-bit values; 0 beyond the text."""
    left, right = (np.zeros((len(at), CONTEXT), "<u4") for _ in range(2))
    for j in range(1, CONTEXT + 1):
        a, has_a, b, has_b = _around(w, at, doc, j)
        for side, word, has in ((left, a, has_a), (right, b, has_b)):
            side[:, j - 1] = np.where(has, np.maximum(word >> U(32), U(1)), U(0))
    return left, right


def _extents(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first j words of each context, for j from 0 to CONTEXT, and how many words there are."""
    out = np.zeros((CONTEXT + 1, len(side)), U)
    for j in range(CONTEXT):
        out[j + 1] = mix(out[j] * U(_BASE) + side[:, j] + U(1))
    return out, (side != 0).sum(axis=1)


def ways(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each way to lay 50 words around a seed: o, the rows that have it, and the value they sort by."""
    seed = batch.column("seed").to_numpy().view(U)
    sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, CONTEXT) for c in ("left", "right")]
    (left, n_left), (right, n_right) = (_extents(x) for x in sides)
    for o in range(WINDOW):
        at = np.flatnonzero((n_left >= o) & (n_right >= CONTEXT - o))
        yield o, at, mix((right[CONTEXT - o][at] ^ mix(seed[at])) * U(_BASE) + left[o][at])


def shared_ways(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes of whole seeds: the ways in which another document agrees, as bits, and the least doc_id that does."""
    lo, hi, first = (batch.column(c).to_numpy() for c in ("lo", "hi", "first"))
    mask, least = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.iinfo(np.int64).max)
    for o, at, value in ways(batch):
        if not len(at):
            continue
        at = at[np.argsort(value, kind="stable")]
        value = np.sort(value)
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        lengths = np.diff(np.append(starts, len(at)))
        several = np.minimum.reduceat(lo[at], starts) != np.maximum.reduceat(hi[at], starts)
        own = at[np.repeat(several, lengths)]
        mask[own] |= 1 << o
        least[own] = np.minimum(least[own], np.repeat(np.minimum.reduceat(first[at], starts)[several], lengths[several]))
    return mask, least


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over suffixes sorted by seed: whole seeds at a time, the last one held back until it is complete."""

    def result(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        mask, least = shared_ways(batch)
        return pa.RecordBatch.from_pydict({"seed": batch.column("seed"), "full": batch.column("full"), "mask": mask, "first": least}).filter(pa.array(mask != 0))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        seed = held.column("seed").to_numpy()
        cut = int(np.searchsorted(seed, seed[-1]))
        if cut > 1 << 13:
            yield result(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield result(held)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, uid, start, end (words, end exclusive), n_words, first_doc_id, is_first: passages that other documents hold as well.

    Words are lower-case runs of letters and digits. Documents are told apart by doc_id and text: repeated
    rows are one document, equal texts under other ids are repeats. A word is in a passage if it is one of
    50 words in a row that another document has in a row as well; first_doc_id is the least doc_id with any
    such 50 words of the passage. Texts of fewer than 50 words, null and empty ones have no row. A null
    doc_id is -1. Extra columns are ignored. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    named = plain_documents(docs).withColumn("uid", F.xxhash64("doc_id", "text"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            w = Words(piece.column("text"))
            at, h = seeds(w)
            doc = w.doc()[at]
            full, room = whole_contexts(w, at, doc, h)
            own = {c: piece.column(c).to_numpy()[doc] for c in ("uid", "doc_id")}
            yield pa.RecordBatch.from_pydict({"seed": h.view(np.int64), "full": full.view(np.int64), "room": room.astype(np.int32)} | own | {"pos": (at - w.first[doc]).astype(np.int32)})

    kept_rows = staged(named.mapInArrow(kept, "seed long, full long, room int, uid long, doc_id long, pos int"), "seeds")
    often = staged(kept_rows.groupBy("seed").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo != hi").select("seed"), "often")
    rows = staged(kept_rows.join(often.hint("merge"), "seed", "left_semi"), "repeated")
    per_context = rows.groupBy("seed", "full", "room").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.min("doc_id").alias("first"), F.min(F.struct("uid", "pos")).alias("one"))
    fulls = staged(per_context, "contexts")
    several = staged(fulls.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "several")
    mixed = fulls.join(several.hint("merge"), "seed").select(F.col("one.uid").alias("uid"), F.struct("one.pos", "seed", "full", "lo", "hi", "first", "n").alias("s"))
    positions = mixed.groupBy("uid").agg(F.collect_list("s").alias("at"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            w = Words(piece.column("text"))
            lists = piece.column("at")
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            own = lists.flatten()
            left, right = contexts(w, w.first[doc] + own.field("pos").to_numpy(), doc)
            sides = {"left": pa.array([x.tobytes() for x in left], pa.binary()), "right": pa.array([x.tobytes() for x in right], pa.binary())}
            yield pa.RecordBatch.from_pydict({c: own.field(c) for c in ("seed", "full", "lo", "hi", "first", "n")} | sides)

    held = named.join(positions, "uid").dropDuplicates(["uid"]).select("text", "at")
    suffixes = staged(held.mapInArrow(around, "seed long, full long, lo long, hi long, first long, n long, left binary, right binary"), "suffixes")
    found = suffixes.where(F.col("n") <= HOT).repartition("seed").sortWithinPartitions("seed").mapInArrow(_matched, "seed long, full long, mask long, first long")
    hot = suffixes.where(F.col("n") > HOT)

    def each_way(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, at, value in ways(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_pydict({c: batch.column(c).to_numpy()[at] for c in ("seed", "full", "lo", "hi", "first")} | {"bit": np.full(len(at), 1 << o, np.int64), "value": value.view(np.int64)})

    if hot.limit(1).count():
        laid = staged(hot.mapInArrow(each_way, "seed long, full long, lo long, hi long, first long, bit long, value long"), "ways")
        equal = staged(laid.groupBy("seed", "bit", "value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first")).where("lo != hi").drop("lo", "hi"), "equal")
        agreed = laid.drop("lo", "hi", "first").join(equal.hint("merge"), ["seed", "bit", "value"]).groupBy("seed", "full").agg(F.bit_or("bit").alias("mask"), F.min("first").alias("first"))
        found = found.union(agreed)
    alone = fulls.where("lo != hi").join(several.hint("merge"), "seed", "left_anti").select("seed", "full", F.col("room").cast("long").alias("mask"), "first")
    masks = staged(found.union(alone), "masks")
    spans = rows.join(masks.hint("merge"), ["seed", "full"]).select("uid", "doc_id", F.struct("pos", "mask", "first").alias("s"))
    listed = spans.groupBy("uid", "doc_id").agg(F.collect_set("s").alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            own, start, end, first = passages(doc, *(lists.flatten().field(c).to_numpy() for c in ("pos", "mask", "first")))
            ids = {c: batch.column(c).to_numpy()[own] for c in ("doc_id", "uid")}
            yield pa.RecordBatch.from_pydict(ids | {"start": start.astype(np.int32), "end": end.astype(np.int32), "first_doc_id": first})

    runs = listed.mapInArrow(merge, "doc_id long, uid long, start int, end int, first_doc_id long")
    return runs.select("doc_id", "uid", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id", (F.col("doc_id") == F.col("first_doc_id")).alias("is_first"))


def passages(doc: np.ndarray, pos: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, end and least first of the runs that the repeated 50 words make, joined where they overlap or touch."""
    bits = [np.flatnonzero((mask >> o) & 1) for o in range(WINDOW)]
    row = np.concatenate(bits)
    start = np.concatenate([pos[at].astype(np.int64) - o for o, at in enumerate(bits)])
    order = np.lexsort((start, doc[row]))
    row, start = row[order], start[order]
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    own = doc[row]
    begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + LEAST)]))
    ends = np.append(begins[1:], len(row)) - 1
    return own[begins], start[begins], start[ends] + LEAST, np.minimum.reduceat(first[row], begins)
