"""Shared pieces of the training-data operators: staging, bounded Arrow batches, vectorised words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import new_folder
from ..functions.staging import written as staged

__all__ = ["BLANKS", "PUNCTUATED", "U", "Words", "bounded_batches", "free_name", "mix", "new_folder", "per_batch", "plain_documents", "released", "staged", "steps", "text_key"]

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Steps after which freed memory is given back.
TRIM = 8

U = np.uint64


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a Python worker holds a few MB of text at a time. Holds for the session from then on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def released(shared) -> None:
    """Give up a broadcast that no later plan reads: executors drop their copies, and it comes again if it is read after all."""
    shared.unpersist(blocking=False)


def free_name(name: str, *taken: str) -> str:
    """A column name like name that none of the taken ones equals, in any case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def plain_documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (null: -1) and text (null: empty) and the named columns; other columns are left behind."""
    return docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)


def _return_memory() -> None:
    """Give what this Python worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about STEP_BYTES of text at most; every TRIM pieces and at the end free memory goes back."""
    for i, piece in enumerate(_pieces(batches, column)):
        yield piece
        if i % TRIM == TRIM - 1:
            _return_memory()
    _return_memory()


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(lengths) - 1) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each text in them (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse. Those of a usual step are kept; a longer text has its own."""
    usual = STEP_BYTES + (1 << 18)
    if n <= usual and _powers:
        return _powers
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(max(n, usual), base, U)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=U))
    if n <= usual:
        _powers[:] = tables
    return tables


#: Bytes between words: ASCII other than letters and digits. Bytes of longer UTF-8 sequences belong to words.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Only blanks and ASCII white space between words.
BLANKS = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])


class Words:
    """Words of a run of texts: 64-bit hashes, byte spans, and where each text's words begin."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = PUNCTUATED, lower: bool = True, fold: np.ndarray | None = None, cut: Callable | None = None):
        """fold: a table that maps bytes first; cut: gives the bytes at which a word begins whatever is before."""
        if lower:
            texts = pc.utf8_lower(texts)
        raw, at = text_bytes(texts)
        if fold is not None:
            raw = fold[raw]
        self.raw, self.at, n = raw, at, len(raw)
        inside = ~separators[raw]
        edge = np.zeros(n + 1, bool)
        if cut is not None:
            edge[:n] = cut(raw)
        edge[at] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & ~(before & ~edge[:n]))
        self.end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        powers, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_VALUES[raw] * powers[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, at)  # words of text i: first[i] to first[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and the index of each run's first word; a text of fewer words is one run."""
        w, first, n = self.hash, self.first, self.counts()
        at = np.flatnonzero(np.arange(len(w)) + k <= np.repeat(first[1:], n))
        h = np.zeros(len(at), U)
        for j in range(k):
            h = h * U(_BASE) + w[at + j]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            own = np.zeros(len(short), U)
            for j in range(k):
                has = n[short] > j
                own = np.where(has, own * U(_BASE) + w[np.minimum(first[short] + j, len(w) - 1)], own)
            at = np.concatenate([at, first[short]])
            h = np.concatenate([h, own])
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
        return mix(h), at


def text_key(column: str = "text"):
    """128 bits that stand for a text."""
    return F.md5(F.col(column).cast("binary"))


def per_batch(f: Callable[[pa.RecordBatch], dict], schema: pa.Schema, column: str = "text"):
    """A function for mapInArrow that applies f to bounded pieces of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches, column):
            yield pa.RecordBatch.from_pydict(f(piece), schema=schema)

    return run
