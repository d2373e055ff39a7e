"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Every text is a bag of shingles of five words. A shingle weighs its frequency in the text times the mean
inverse document frequency of its words, which is counted over all documents. (The inverse frequency of
the shingle itself would let a group of copies push its own shared shingles down against each copy's few
changed ones, so that the similarity of two copies would fall as their group grows.) A word in fewer
than one of 512 documents weighs as one in exactly that many: so the table of word frequencies has at
most 512 times the mean number of distinct words of a text, whatever the size of the corpus.

1. Improved consistent weighted sampling gives 42 samples a text, in 14 bands of 3. At a similarity of
   0.8 a pair shares no band in 4 of 100,000 cases.
2. Equal texts are one text. Texts that share a band are candidates; candidate components come from
   stars, one for each bucket, never from all pairs of a bucket.
3. Each component's best-connected text is verified against all others of its component. What isn't
   tied to it is compared with the whole component in blocks of about 384 by 384 texts or 1 MB by 1 MB, as a product
   of sparse bags inside a task; only links go out, at most one for each text and block.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, bounded_batches, free_name, mix, plain_documents, released, staged, steps
from .components import connected_components

SHINGLE, BANDS, ROWS, RARE = 5, 14, 3, 1 / 512
#: Texts, and bytes of them, on either side of a block that is compared in one task.
BLOCK, BLOCK_BYTES = 384, 1 << 20
#: Entries that one partition's counts of words hold before they are merged.
MERGE = 1 << 20


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def _word_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0
    for piece in steps(batches):
        w = Words(piece.column("text"))
        pair = np.unique((w.doc().astype(U) << U(48)) | (w.hash >> U(16)))
        k, c = np.unique(pair & U((1 << 48) - 1), return_counts=True)
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > MERGE:
            k, c = merged(keys, counts)
            keys, counts, held = [k], [c], 0 if len(k) < MERGE // 2 else len(k) // 2
            if len(k) > MERGE:  # a partition of ever new words
                yield pa.RecordBatch.from_pydict({"word": k.astype(np.int64), "df": c})
                keys, counts, held = [], [], 0
    if keys:
        k, c = merged(keys, counts)
        for i in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_pydict({"word": k[i : i + (1 << 16)].astype(np.int64), "df": c[i : i + (1 << 16)]})


class Idf:
    """Inverse document frequencies of the words found in at least RARE of the documents; others weigh as those."""

    def __init__(self, words: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(words)
        self.words = np.concatenate([words[order].astype(U), np.array([~U(0)], U)])
        self.top = math.log1p(1 / RARE)
        self.value = np.append(np.log1p(1 / np.maximum(df[order] / max(n, 1), RARE)), self.top).astype(np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        key = hashes >> U(16)
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, self.value[at], np.float32(self.top)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> Idf:
    """The bounded table of word frequencies over all documents."""
    n = docs.count()
    rows = docs.select("text").mapInArrow(_word_frequencies, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    table = rows.where(F.col("df") >= F.lit(n * RARE)).toPandas()
    return Idf(table["word"].to_numpy(np.int64), table["df"].to_numpy(np.int64), n)


def bags(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle, frequency and mean IDF of each distinct shingle of each text, by text."""
    w = Words(texts)
    h, at = w.shingles(SHINGLE)
    value = np.concatenate([[0], np.cumsum(idf.of(w.hash), dtype=np.float64)])
    doc = np.searchsorted(w.first, at, side="right") - 1
    end = np.minimum(at + SHINGLE, w.first[doc + 1])
    weight = (value[end] - value[at]) / np.maximum(end - at, 1)
    key, first, tf = np.unique((doc.astype(U) << U(48)) | (h >> U(16)), return_index=True, return_counts=True)
    return (key >> U(48)).astype(np.int64), mix(key & U((1 << 48) - 1)), tf, np.maximum(weight[first], 1e-6)


class Sampler:
    """Improved consistent weighted samples; Gamma(2, 1) draws by quantile tables indexed by bits of the hash."""

    BITS = 12

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 1 << 63, samples, dtype=np.int64).astype(U)
        draws = np.sort(rng.gamma(2, 1, (1 << self.BITS) * 64)).reshape(-1, 64).mean(axis=1)
        self.r = draws.astype(np.float32)
        self.inverse = (1 / draws).astype(np.float32)
        self.log_c = np.log(draws).astype(np.float32)

    def sketch(self, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n rows of samples; texts without elements have the largest value throughout."""
        out = np.full((n, len(self.seeds)), np.iinfo(np.int64).max, np.int64)
        log_w, mask, step = np.log(weight).astype(np.float32), U((1 << self.BITS) - 1), 1 << 11
        for i in range(0, len(element), step):
            e, d = element[i : i + step, None], doc[i : i + step]
            x = (e ^ self.seeds) * U(0xD6E8FEB86659FD93)
            x ^= x >> U(32)
            x *= U(0xA24BAED4963EE407)
            x ^= x >> U(29)
            g = (x & mask).astype(np.int32)
            beta = ((x >> U(40)).astype(np.float32)) * np.float32(2.0**-24)
            t = np.floor(log_w[i : i + step, None] * self.inverse[g] + beta)
            a = self.log_c[((x >> U(12)) & mask).astype(np.int32)] - self.r[g] * (t - beta + np.float32(1))
            bits = a.view(np.int32)
            bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
            low = ((x >> U(24)) ^ (t.astype(np.int64).view(U) * U(0x9E3779B1))) & U(0xFFFFFFFF)
            packed = (bits.astype(np.int64) << 32) | low.view(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            rows = d[starts]
            out[rows] = np.minimum(out[rows], np.minimum.reduceat(packed, starts, axis=0))
        return out


def band_values(sketch: np.ndarray) -> np.ndarray:
    parts = (sketch & 0xFFFFFFFF).astype(U).reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2]).copy()
    for j in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.astype(np.int64)


def elements(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, element and weight: the j-th occurrence of a shingle is an element, so that shared elements sum to the least frequency."""
    doc, shingle, tf, weight = bags(texts, idf)
    nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    return np.repeat(doc, tf), mix(np.repeat(shingle, tf) + nth.astype(U) * U(0x9E3779B97F4A7C15)), np.repeat(weight, tf)


def similarities(texts_a: pa.Array, texts_b: pa.Array, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of text i on the left and text i on the right."""
    n = len(texts_a)
    (da, ea, wa), (db, eb, wb) = elements(texts_a, idf), elements(texts_b, idf)
    key_a, key_b = (da.astype(U) << U(40)) | (ea >> U(24)), (db.astype(U) << U(40)) | (eb >> U(24))
    shared, ia, _ = np.intersect1d(key_a, key_b, return_indices=True)
    both = np.bincount(da[ia], wa[ia], n)
    total = np.bincount(da, wa, n) + np.bincount(db, wb, n) - both
    return np.where(total > 0, both / np.maximum(total, 1e-12), 0.0)


def block_similarities(texts: pa.Array, idf: Idf, rows: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the texts in rows with all texts, by products of dense slices of the shared elements."""
    n = len(texts)
    doc, element, weight = elements(texts, idf)
    column = np.unique(element, return_inverse=True)[1]
    size, total = np.bincount(column), np.bincount(doc, weight, n)
    at = np.flatnonzero(size[column] > 1)
    doc, column, root = doc[at], column[at], np.sqrt(weight[at]).astype(np.float32)
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    order = np.argsort(column, kind="stable")
    doc, column, root = doc[order], column[order], root[order]
    both, width = np.zeros((len(rows), n), np.float32), 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((n, width), np.float32)
        dense[doc[a:b], column[a:b] - lo] = root[a:b]
        both += dense[rows] @ dense.T
    union = total[rows][:, None] + total[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1e-12), 0)


def _spanning(similar: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie together what the matrix of similar pairs ties together."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(similar), strict=True):
        a, b = int(rows[i]), int(j)
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            links.append((a, b))
    return links


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), one row for each row of docs.

    Equal texts are always of one class, so null and empty texts are one class, as are texts without a
    word that are equal. Texts of one to four words are one shingle: they are similar if their words are
    the same. Repeated rows and equal doc_ids with different texts keep a row each. A null doc_id is -1.
    Extra columns are ignored. No rows: no rows.
    """
    sketches, found = _classes(docs, threshold)
    return sketches.select("doc_id", "key").join(found.select("key", "class_id"), "key").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One row of docs for each class, with all columns: that of the least doc_id, and of the least text hash among those.

    Columns may have any names. Null and empty texts are one class, a null doc_id counts as -1; equal texts
    under one doc_id leave one row. No rows: no rows.
    """
    _, found = _classes(docs, threshold)
    own_id, own_key = free_name("kept_id", *docs.columns), free_name("kept_key", *docs.columns)
    kept = staged(found.groupBy("class_key").agg(F.min(F.struct("rep", "key")).alias("s")).select(F.col("s.rep").alias(own_id), F.col("s.key").alias(own_key)), "survivors")
    keyed = docs.withColumns({own_id: F.coalesce("doc_id", F.lit(-1)).cast("long"), own_key: F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))})
    return keyed.join(kept, [own_id, own_key], "left_semi").dropDuplicates([own_id, own_key]).drop(own_id, own_key)


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, text key and bands; and for each text its key, least doc_id, class_key and class_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = plain_documents(docs)
    idf = document_frequencies(docs)
    shared = spark.sparkContext.broadcast(idf)
    sampler = Sampler()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            texts = piece.column("text")
            doc, shingle, tf, weight = bags(texts, shared.value)
            bands = band_values(sampler.sketch(doc, shingle, tf * weight, len(texts)))
            has = np.zeros(len(texts), bool)
            has[doc] = True
            yield pa.RecordBatch.from_pydict(
                {"doc_id": piece.column("doc_id"), "key": pa.array([hashlib.md5(t.as_buffer() if t.is_valid else b"").digest() for t in texts], pa.binary()), "bands": pa.array([b if ok else [] for b, ok in zip(bands, has, strict=True)], pa.list_(pa.int64()))},
            )

    sketches = staged(docs.mapInArrow(sketched, "doc_id long, key binary, bands array<long>"), "sketches")
    # One row for each text. Bands go out only with the first doc_id's row, as they follow from the text.
    texts = sketches.groupBy("key").agg(F.min("doc_id").alias("rep"))
    banded = sketches.join(texts.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"], "left_semi")
    members = banded.select("key", F.explode("bands").alias("v")).distinct()
    buckets = members.groupBy("v").agg(F.count("*").alias("n"), F.min("key").alias("head")).where("n > 1")
    stars = staged(members.join(buckets.hint("merge"), "v"), "stars")
    candidate = connected_components(stars.select(F.col("head").alias("a"), F.col("key").alias("b")))
    degree = stars.groupBy("key").agg(F.sum("n").alias("degree"))
    joined = candidate.withColumnRenamed("node", "key").withColumnRenamed("component", "comp").join(degree, "key").join(texts, "key")
    keyed = docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    store = staged(
        keyed.join(joined.withColumnRenamed("rep", "doc_id"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("comp", "key", "degree", F.octet_length("text").alias("size"), "text"),
        "candidates",
    )
    leaders = store.groupBy("comp").agg(F.max(F.struct("degree", "key")).alias("l")).select("comp", F.col("l.key").alias("leader"))
    lead = store.join(leaders.withColumnRenamed("leader", "key"), ["comp", "key"]).select("comp", F.col("key").alias("leader"), F.col("text").alias("leader_text"))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            s = similarities(piece.column("text"), piece.column("leader_text"), shared.value)
            same = np.array([a == b for a, b in zip(piece.column("key").to_pylist(), piece.column("leader").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_pydict({c: piece.column(c) for c in ("key", "comp", "leader", "size")} | {"linked": pa.array(same | (s >= threshold - 1e-6))})

    # A component may hold a third of all texts: merge joins of plain shuffles, so that Spark can split it.
    tested = staged(store.join(lead.hint("merge"), "comp").mapInArrow(star, "key binary, comp binary, leader binary, size int, linked boolean"), "tested")
    star_links = tested.where("linked").select(F.col("leader").alias("a"), F.col("key").alias("b"))
    # What its leader does not tie in meets its whole component, block by block.
    blocks_of = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1))
    loose = ~F.col("linked")
    sizes = tested.groupBy("comp").agg(F.count("*").alias("n"), F.count_if(loose).alias("loose"), F.sum("size").alias("bytes"), F.sum(F.when(loose, F.col("size")).otherwise(0)).alias("loose_bytes")).where("loose > 0 and n > 2")
    sizes = staged(sizes.select("comp", blocks_of(F.col("n"), F.col("bytes")).alias("np"), blocks_of(F.col("loose"), F.col("loose_bytes")).alias("nq")), "sizes")
    rest = tested.where(F.col("key") != F.col("leader")).join(sizes.hint("merge"), "comp").join(store.select("comp", "key", "text"), ["comp", "key"])
    dealt = rest.withColumn("p", F.pmod(F.xxhash64("key"), F.col("np"))).withColumn("q", F.pmod(F.xxhash64("key"), F.col("nq")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = dealt.where(loose).select("comp", upto("np").alias("p"), "q", "key", "text", F.lit(True).alias("is_left"))
    right = dealt.select("comp", "p", upto("nq").alias("q"), "key", "text", F.lit(False).alias("is_left"))

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "is_left"]).reset_index(drop=True)
        rows = np.flatnonzero(pdf["is_left"].to_numpy())
        similar = block_similarities(pa.array(pdf["text"], pa.large_string()), shared.value, rows) >= threshold - 1e-6
        links = _spanning(similar, rows)
        return pd.DataFrame({"a": pdf["key"].to_numpy()[[a for a, _ in links]], "b": pdf["key"].to_numpy()[[b for _, b in links]]}) if links else pd.DataFrame({"a": [], "b": []}, dtype=object)

    block_links = left.unionByName(right).groupBy("comp", "p", "q").applyInPandas(blocks, "a binary, b binary")
    classes = connected_components(star_links.union(block_links))
    named = classes.withColumnRenamed("node", "key").join(texts, "key")
    heads = staged(named.groupBy("component").agg(F.min("rep").alias("class_id")), "heads")
    final = named.join(heads.hint("merge"), "component").select("key", F.col("component").alias("class_key"), "class_id")
    # Written, so that the join with all rows has two plain shuffles and a text with very many copies is split.
    result = staged(texts.join(final, "key", "left").select("key", "rep", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("class_id", "rep").alias("class_id")), "classes")
    released(shared)
    return sketches, result
