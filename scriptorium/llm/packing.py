"""Sequence packing: shortest-pack-first over the histogram of piece lengths, patterns joined back by rank.

Texts become token ids; a document longer than a sequence is cut into whole sequences and a rest. The
driver only sees the histogram of lengths, of as many entries as a sequence has places. Lengths are placed
longest first, each into the pack with most room; packs alike are one pattern with a count, so the number
of patterns depends on the sequence length and not on the corpus. If no pack has room, as many are opened
as the tokens still to be placed need, one at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, plain_documents, staged, steps
from .tokens import encoder

CAPACITY = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows of one length that are ranked in one task.
RANKED = 100_000


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns that hold each length as often as the histogram says."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    left = sum(length * n for length, n in histogram.items())
    room = capacity
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = max((r for r in by_room if r >= length), default=0)
            if not room:
                count, pattern, room = min(n, max(1, -(-left // capacity))), (), capacity
            else:
                count, pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            used = min(count, n)
            if count > used:
                by_room.setdefault(room, []).append((count - used, pattern))
            by_room.setdefault(room - length, []).append((used, (*pattern, length)))
            n -= used
            left -= used * length
    return [x for packs in by_room.values() for x in packs]


class Places:
    """Where the piece of a length and rank goes: sequence and offset."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        rank: dict[int, int] = {}
        rows, base = [], 0
        for count, pattern in patterns:
            offset = 0
            for length in pattern:
                lo = rank.get(length, 0)
                rows.append((length, lo, base, offset))
                rank[length] = lo + count
                offset += length
            base += count
        table = np.array(sorted(rows) or [(0, 0, 0, 0)], np.int64).T
        self.key, self.lo, self.base, self.offset = (table[0] << 48) + table[1], table[1], table[2], table[3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        return self.base[at] + rank - self.lo[at], self.offset[at]


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document's ids, with the ids as unsigned 32-bit bytes if asked for."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for piece in steps(batches):
            ids, at = enc.encode(piece.column("text"))
            out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                own = np.append(ids[a:b], np.array([end_id], ids.dtype)).astype("<u4")
                for start in range(0, len(own), capacity):
                    part = own[start : start + capacity].tobytes()
                    for name, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), len(own), part), strict=True):
                        out[name].append(value)
            types = {name: pa.int64() for name in out} | {"ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({name: pa.array(x, types[name]) for name, x in out.items() if with_ids or name != "ids"})

    return plain_documents(docs).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every id of every document (null text: only end_id) in one piece of one sequence.

    Pieces of a length are alike to the packing; their rank is by doc_id within parts by a hash, so rows
    repeated or with equal doc_ids get ranks of their own. Lengths are ranked in parts, so that a length
    that a third of all documents have is no single task. No rows: no pieces. Extra columns are ignored.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(shortest_pack_first(histogram, capacity)))
    parts = 32 + sum(histogram.values()) // RANKED
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + local).drop("part", "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    columns = PIECES + ", ids binary" * with_ids
    return ranked.select(*[c.split()[0] for c in columns.split(", ")], F.col("rank").cast("long")).mapInArrow(place, f"{columns}, sequence_id long, offset long")
