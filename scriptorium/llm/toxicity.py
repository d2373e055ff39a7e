"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled rows, at most EXAMPLES of each class, those with the least
hashes of their ids. Every word of an example is indexed. It weighs by its inverse document frequency over
all documents times one plus its likelihood-ratio statistic (shrunk, see CHANCE), which is near 0 for a word that has nothing to
do with the label. A text's neighbours are found exactly: blocks of examples are visited by falling bound, the
sum of the query's weights times each term's largest weight in the block, until no block can hold a nearer
example. Votes weigh by similarity; an isotonic fit on leave-one-out votes of the examples, for which an
example's own words and label don't count, weighted back to the frequency of the classes, turns them into probabilities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, Words, bounded_batches, plain_documents, steps

EXAMPLES, NEIGHBOURS, BLOCK = 1024, 16, 64
#: Scores of term vectors that a worker keeps, by a digest of the vector.
KEPT = 20_000
PRIOR_WEIGHT = 0.5
#: Likelihood-ratio statistic of which half counts; few words reach it by chance.
CHANCE = 24.0
RESULT = "doc_id long, score double, evidence array<long>"


def term_counts(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and frequency of the vocabulary's words (sorted hashes)."""
    if not len(vocabulary) or not len(w.hash):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == w.hash)
    key, tf = np.unique(w.doc()[hit] * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), tf


def evidence(k: np.ndarray, n: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood-ratio statistic of words in k of n1 toxic and n - k of n0 clean examples, shrunk towards 0 where chance gives as much."""
    share = n1 / max(1, n1 + n0)

    def log(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)

    without = n1 + n0 - n
    x = np.maximum(0, 2 * (log(k, n * share) + log(n - k, n * (1 - share)) + log(n1 - k, without * share) + log(n0 - n + k, without * (1 - share))))
    return x * x / (x + CHANCE)


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks of BLOCK examples with each term's largest weight."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.idf, self.ids, self.labels, self.n = idf, ids, labels, len(ids)
        weight = (1 + np.log(tf)) * idf[term]
        weight = weight / np.sqrt(np.bincount(doc, weight**2, self.n))[doc]
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        block = term[order] * (self.n // BLOCK + 1) + self.doc // BLOCK
        self.cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        self.block = self.doc[self.cut] // BLOCK
        self.most = np.maximum.reduceat(self.weight, self.cut) if len(block) else np.zeros(0)
        self.first_block = np.searchsorted(self.cut, self.first)
        self.cut = np.append(self.cut, len(self.doc))
        self.empty = np.bincount(doc, minlength=self.n) == 0

    def search(self, term: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS, without: int = -1, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, nearest first; equally near ones by index. The terms weigh as in the index if not by weight."""
        q = (1 + np.log(tf)) * (self.idf[term] if weight is None else weight)
        q = q / np.sqrt((q**2).sum())
        first = self.first_block[term]
        own = self.first_block[term + 1] - first
        at = spans(first, own)
        which, block = np.repeat(q, own), self.block[at]
        bound = np.bincount(block, self.most[at] * which, self.n // BLOCK + 1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found_doc, found_sim, kth, step, i = np.zeros(0, np.int64), np.zeros(0), -1.0, 4, 0
        while i < len(order) and (len(found_doc) < k or bound[order[i]] >= kth - 1e-12):
            chosen = np.zeros(self.n // BLOCK + 1, bool)
            chosen[order[i : i + step]] = True
            use = np.flatnonzero(chosen[block])
            start = self.cut[at[use]]
            lengths = self.cut[at[use] + 1] - start
            rows = spans(start, lengths)
            sims = np.bincount(self.doc[rows], self.weight[rows] * np.repeat(which[use], lengths), self.n)
            if without >= 0:
                sims[without] = 0
            docs = np.flatnonzero(sims)
            if len(docs) > k:
                docs = docs[sims[docs] >= np.partition(sims[docs], -k)[-k]]
            found_doc, found_sim = np.concatenate([found_doc, docs]), np.concatenate([found_sim, sims[docs]])
            best = np.lexsort((found_doc, -found_sim))[:k]
            found_doc, found_sim = found_doc[best], found_sim[best]
            kth = found_sim[-1] if len(found_sim) == k else -1.0
            i += step
            step *= 2
        return found_doc, found_sim


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at first, one run after the other."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing least-squares fit: middle x and value of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([b * w, w, a * w])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Scorer:
    """Votes of the nearest examples, calibrated."""

    def __init__(self, vocabulary: np.ndarray, index: BlockMaxIndex | None, class_weight: np.ndarray, prior: float):
        self.vocabulary, self.index, self.prior = vocabulary, index, prior
        self.neutral, self.x, self.y = prior, np.array([0.0, 1.0]), np.array([prior, prior])
        self.known: dict[bytes, tuple[float, list[int]]] = {}
        if index is not None:
            w = class_weight[index.labels]
            none = index.empty
            toxic = (w * index.labels)[none].sum() + PRIOR_WEIGHT * prior
            self.neutral = float(toxic / (w[none].sum() + PRIOR_WEIGHT))

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        if not len(found):
            return self.prior
        w = np.maximum(sims, 0) ** 2
        return float(((w * self.index.labels[found]).sum() + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def calibrate(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, class_weight: np.ndarray) -> None:
        """Fit probabilities to the votes that each example has from the others, with words weighed without it as those of a new text are."""
        label, size = self.index.labels, len(idf)
        n, k = np.bincount(term, minlength=size), np.bincount(term, label[doc], size)
        n1, n0 = int(label.sum()), int((1 - label).sum())
        votes, who = [], []
        for i, a, b in runs(doc):
            y, t = label[i], term[a:b]
            others = n[t] > 1
            if others.any():
                t, f = t[others], tf[a:b][others]
                own = idf[t] * (1 + evidence(k[t] - y, n[t] - 1, n1 - y, n0 - 1 + y))
                votes.append(self.vote(*self.index.search(t, f, without=i, weight=own)))
                who.append(i)
        if votes:
            y = label[who]
            self.x, self.y = isotonic(np.array(votes), y.astype(float), class_weight[y])

    def score(self, term: np.ndarray, tf: np.ndarray) -> tuple[float, list[int]]:
        key = hashlib.blake2b(term.tobytes() + tf.tobytes(), digest_size=16).digest()
        if key not in self.known:
            if len(self.known) > KEPT:
                self.known = {}
            found, sims = self.index.search(term, tf)
            p = self.vote(found, sims)
            # A little of the raw vote keeps the order inside a pool.
            self.known[key] = (float(np.clip(0.98 * np.interp(p, self.x, self.y) + 0.02 * p, 0, 1)), self.index.ids[found[:5]].tolist())
        return self.known[key]

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Score and ids of the nearest examples of each text."""
        w = Words(texts)
        score, nearest = np.where(w.counts() == 0, self.neutral, self.prior), [[]] * len(texts)
        if self.index is not None:
            doc, term, tf = term_counts(w, self.vocabulary)
            for i, a, b in runs(doc):
                score[i], nearest[i] = self.score(term[a:b], tf[a:b])
        return score, nearest


def runs(doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal values."""
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        if b > a:
            yield int(doc[a]), a, b


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from labels (doc_id, toxic 0 or 1) of documents that aren't held out; null labels are none."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    class_weight = np.ones(2)
    none = np.zeros(0, U)
    if len(total) < 2:
        return Scorer(none, None, class_weight, prior)
    least = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for c in (0, 1)]
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for half in least for r in half.collect()], "doc_id long, toxic int")
    examples = docs.join(F.broadcast(chosen), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            w = Words(piece.column("text"))
            own = np.unique(w.hash)
            doc, term, tf = term_counts(w, own)
            at = pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)), pa.int32())
            lists = {"word": pa.ListArray.from_arrays(at, own.view(np.int64)[term]), "tf": pa.ListArray.from_arrays(at, tf)}
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "toxic": piece.column("toxic")} | lists)

    got = examples.mapInArrow(vectors, "doc_id long, toxic int, word array<long>, tf array<long>").toArrow().combine_chunks()
    if not got.num_rows:
        return Scorer(none, None, class_weight, prior)
    lists = [(w.values.to_numpy().view(U), f.values.to_numpy()) for w, f in zip(got["word"], got["tf"], strict=True)]
    ids, label = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], lists[i][0].tobytes(), lists[i][1].tobytes()))
    ids, label, lists = ids[order], label[order], [lists[i] for i in order]
    doc = np.repeat(np.arange(len(ids)), [len(w) for w, _ in lists])
    vocabulary, term = np.unique(np.concatenate([w for w, _ in lists]), return_inverse=True)
    tf = np.concatenate([f for _, f in lists])
    if not len(vocabulary):
        return Scorer(none, None, class_weight, prior)
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value), np.int64), 0
        for piece in steps(batches):
            n += piece.num_rows
            df += np.bincount(term_counts(Words(piece.column("text")), shared.value)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(at, -1), "df": np.append(df[at], n)})

    counted = docs.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log1p(df[-1] / np.maximum(df[:-1], 1))
    n, k = np.bincount(term), np.bincount(term, label[doc])
    weight = idf * (1 + evidence(k, n, int(label.sum()), int((1 - label).sum())))
    class_weight = np.array([total[c] / max(1, (label == c).sum()) for c in (0, 1)])
    scorer = Scorer(vocabulary, BlockMaxIndex(doc, term, tf, weight, ids, label), class_weight, prior)
    scorer.calibrate(doc, term, tf, idf, class_weight)
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) of each row of docs.

    Null and empty texts, and others without words, score as the labelled ones without words do. Texts whose
    words no example has score the share of toxic labels. Without labels, or with one class only, every score is the share of toxic labels. Repeated
    rows keep a row each. Extra columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = plain_documents(docs)
    scorer = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for piece in steps(batches):
            score, nearest = s.scores(piece.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "score": score, "evidence": pa.array(nearest, pa.list_(pa.int64()))})

    scored = docs.mapInArrow(run, RESULT)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose text isn't predicted to be toxic."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scorer = spark.sparkContext.broadcast(fit(plain_documents(docs), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for piece in steps(batches):
            yield piece.filter(pa.array(s.scores(piece.column("text"))[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
