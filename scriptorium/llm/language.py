"""Language of whole texts: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word scores by the likelihood of its byte n-grams under each language; languages that aren't written in
the word's script are out. The best labelling of a text's words pays a penalty for each switch. Long texts
are cut into segments for the computation only: the best score from every language before a segment to
every language at its end is found for all segments at once, then the segments are chained, so the result
is that of one pass over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Words, bounded_batches, plain_documents, steps
from .toxicity import held_out, runs

#: Training rows of each language, dealt over SALTS parts by the hash of the id; of large languages only rows with low hashes come that far.
EXAMPLES, SALTS = 1536, 32
ORDERS, BITS = (1, 2, 3, 4), 14
SIZE = 1 << BITS
#: Nats that a switch of language costs; n-grams of a word overlap, so their sum counts half.
SWITCH, SHARE = 12.0, 0.5
SEGMENT = 96
#: Rows of ids up to which the join is broadcast.
BROADCAST_ROWS = 1_000_000
UNKNOWN = "und"

SEPARATORS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
ASCII_LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
LETTER = re.compile(r"[^\W\d_]")


# Ranges of code points by script, as Unicode's blocks have them, ends included.
SCRIPT_RANGES = (
    (1, ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))),  # Latin
    (2, ((0x370, 0x3FF), (0x1F00, 0x1FFF))),  # Greek
    (3, ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),  # Cyrillic
    (4, ((0x530, 0x58F), (0x10A0, 0x10FF))),  # Armenian, Georgian
    (5, ((0x590, 0x5FF),)),  # Hebrew
    (6, ((0x600, 0x7BF), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),  # Arabic and its kin
    (7, ((0x900, 0xDFF),)),  # scripts of India
    (8, ((0xE00, 0x109F), (0x1780, 0x17FF))),  # Thai, Lao, Tibetan, Burmese, Khmer
    (9, ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF))),  # Hangul
    (10, ((0x3040, 0x30FF), (0x31F0, 0x31FF))),  # Kana
    (11, ((0x2E80, 0x2FDF), (0x3100, 0x312F), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),  # Han
)


def _scripts() -> np.ndarray:
    """Script by a character's first byte and the low six bits of its second: exact up to U+07FF, by runs of 64 code points beyond, of 4,096 from U+10000 on.

    Where a run holds several scripts the one of its last code point counts. Marks, digits and symbols have none, 0.
    """
    table = np.zeros((256, 64), np.int64)
    for script, ranges in SCRIPT_RANGES:
        for lo, hi in ranges:
            for code in [*range(lo, min(hi, 0x7FF) + 1), *range(max(lo | 63, 0x83F), min(hi, 0xFFFF) + 1, 64), *range(max(lo | 4095, 0x10FFF), hi + 1, 4096)]:
                raw = chr(code).encode("utf-8", "surrogatepass")
                table[raw[0], slice(None) if len(raw) == 1 else raw[1] & 63] = script
    return table.ravel()


SCRIPTS = _scripts()
N_SCRIPTS = 1 + len(SCRIPT_RANGES)
BUCKETS = len(ORDERS) * SIZE + N_SCRIPTS


class Vocabulary:
    """The distinct words of a run of texts, as bytes with a blank on either side."""

    def __init__(self, texts: pa.Array):
        padded = pc.binary_join_element_wise("", pc.fill_null(texts, ""), "", " ")
        self.words = w = Words(padded, SEPARATORS)
        _, first, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        begin, end = w.start[first] - 1, w.end[first] + 1
        lengths = end - begin
        self.to = np.cumsum(lengths)
        at = np.repeat(begin - (self.to - lengths), lengths) + np.arange(int(lengths.sum()))
        data = w.raw[at]
        data = np.where(SEPARATORS[data], np.uint8(32), data)
        self.word = np.repeat(np.arange(len(first)), lengths)
        self.begin, self.data, self.n = self.to - lengths, data, len(first)
        self.bytes = (w.end - w.start)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: word and bucket of its n-grams."""
        d = self.data.astype(U)
        left = self.to[self.word] - np.arange(len(d))
        h = np.zeros(len(d), U)
        for i, n in enumerate(ORDERS):
            h = h * U(0x9E3779B97F4A7C15) + np.concatenate([d[n - 1 :], np.zeros(min(n - 1, len(d)), U)])[: len(d)] + U(1)
            ok = np.flatnonzero(left >= n)
            yield self.word[ok], ((h[ok] * U(0xA24BAED4963EE407)) >> U(64 - BITS)).astype(np.int64) + i * SIZE

    def scripts(self) -> np.ndarray:
        """The script of each word; of several, the one listed last."""
        if not self.n:
            return np.zeros(0, np.int64)
        second = np.append(self.data[1:], 0).astype(np.int64) & 63
        return np.maximum.reduceat(SCRIPTS[self.data.astype(np.int64) * 64 + second], self.begin)


class Model:
    """Log likelihoods of n-grams by language, and which languages use which scripts."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        grams = counts[:, : len(ORDERS) * SIZE].reshape(len(languages), len(ORDERS), SIZE)
        smooth = grams + 0.1
        self.table = np.log(smooth / smooth.sum(axis=2, keepdims=True)).reshape(len(languages), len(ORDERS) * SIZE).T.astype(np.float32).copy()
        script = counts[:, len(ORDERS) * SIZE :]
        share = script / np.maximum(script.sum(axis=1, keepdims=True), 1)
        allowed = (share >= 0.01).T
        self.out = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, -50.0)

    def word_scores(self, v: Vocabulary) -> np.ndarray:
        out = np.zeros((v.n, len(self.languages)))
        for word, bucket in v.grams():
            if len(word):
                starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0)
        return SHARE * (out - out.max(axis=1, keepdims=True, initial=-np.inf)) + self.out[v.scripts()] if v.n else out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """Labels of the words first[i] to first[i + 1] of each text i with the greatest sum of scores less penalties."""
    n_words, n = scores.shape
    labels = np.zeros(n_words, np.int64)
    if not n_words or n == 1:
        return labels
    counts = np.diff(first)
    n_segments = -(-counts // segment)
    doc = np.repeat(np.arange(len(counts)), n_segments)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    begin = first[doc] + nth * segment
    length = np.minimum(first[doc + 1] - begin, segment)
    order = np.argsort(-length, kind="stable")
    begin, length, nth, doc = begin[order], length[order], nth[order], doc[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    # Best score from each language before a segment to each at its end.
    m = np.where(np.eye(n, dtype=bool), 0.0, -penalty)[None].repeat(len(begin), axis=0)
    for t in range(int(length[0])):
        k = live[t]
        own = m[:k]
        if t:
            np.maximum(own, own.max(axis=2, keepdims=True) - penalty, out=own)
        own += scores[begin[:k] + t][:, None, :]
    head = np.cumsum(n_segments) - n_segments
    total = np.zeros((len(counts), n))
    came = np.zeros((len(begin), n), np.int64)
    for j in range(int(n_segments.max())):
        d = np.flatnonzero(n_segments > j)
        s = place[head[d] + j]
        if j == 0:
            total[d] = m[s].max(axis=1)
            came[s] = m[s].argmax(axis=1)
        else:
            step = total[d][:, :, None] + m[s]
            came[s] = step.argmax(axis=1)
            total[d] = step.max(axis=1)
    entry, leave = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    state = total.argmax(axis=1)
    for j in range(int(n_segments.max()) - 1, -1, -1):
        d = np.flatnonzero(n_segments > j)
        s = place[head[d] + j]
        leave[s] = state[d]
        entry[s] = came[s, state[d]]
        state[d] = entry[s]
    # Once more with the language before each segment known, keeping where each best score came from.
    v = np.full((len(begin), n), -penalty)
    v[np.arange(len(begin)), entry] = 0.0
    back = np.zeros((int(length[0]), len(begin), n), np.int16)
    for t in range(int(length[0])):
        k = live[t]
        own = v[:k]
        best = own.argmax(axis=1)
        if t:
            jump = own[np.arange(k), best][:, None] - penalty
            switch = jump > own
            back[t, :k] = np.where(switch, best[:, None], np.arange(n))
            np.maximum(own, jump, out=own)
        own += scores[begin[:k] + t]
    state = leave.copy()
    for t in range(int(length[0]) - 1, -1, -1):
        k = live[t]
        labels[begin[:k] + t] = state[:k]
        state[:k] = back[t, np.arange(k), state[:k]]
    return labels


def fit(docs: DataFrame) -> Model:
    """A model from text and lang of rows that aren't held out: at most EXAMPLES rows of each language."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    h = F.xxhash64("doc_id")
    nth = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))
    # Twice as many as are wanted by the hash alone, so that the windows get a bounded number of rows at any size.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * EXAMPLES / n))]) if counts else F.create_map().cast("map<string,double>")
    low = F.pmod(F.shiftright(h, 16), F.lit(1 << 20)) < F.ceil(F.try_element_at(share, F.col("lang")) * (1 << 20))
    chosen = known.where(low).select("doc_id", "lang", h.alias("h"), F.pmod(F.shiftright(h, 8), F.lit(SALTS)).alias("salt")).distinct().withColumn("nth", nth).where(F.col("nth") <= EXAMPLES // SALTS).select("doc_id", "lang")
    n = chosen.count()
    examples = known.select("doc_id", "lang", "text").join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for piece in steps(batches):
            lang = np.array(piece.column("lang").to_pylist(), object)
            for code in sorted(set(lang)):
                v = Vocabulary(piece.column("text").filter(pa.array(lang == code)))
                often = np.bincount(v.of, minlength=v.n)
                own = held.setdefault(code, np.zeros(BUCKETS))
                for word, bucket in v.grams():
                    own += np.bincount(bucket, often[word], BUCKETS)
                own += np.bincount(len(ORDERS) * SIZE + v.scripts(), often, BUCKETS)
        for code, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [code] * len(at), "bucket": at, "n": own[at]})

    # The examples are few: so few tasks that their counts are few as well.
    rows = examples.repartition(8).mapInArrow(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, rows["lang"].to_numpy(str)) if len(rows) else [], rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    return Model(languages, counts)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (language, first word, word after the last) of each row of docs.

    lang_pred is the language with most bytes of words, score its share of them. Null texts and texts
    without a letter are `und` with score 0 and no spans, as are all if no row has a language to learn.
    Repeated rows keep a row each. Extra columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for piece in steps(batches):
            n, texts = piece.num_rows, piece.column("text")
            pred, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            v = Vocabulary(texts)
            w = v.words
            if m.languages and len(w.hash):
                label = viterbi(m.word_scores(v)[v.of], w.first)
                doc = w.doc()
                share = np.bincount(doc * len(m.languages) + label, v.bytes, n * len(m.languages)).reshape(n, -1)
                best, total = share.argmax(axis=1), share.sum(axis=1)
                ascii_letters = np.bincount(doc, np.maximum.reduceat(ASCII_LETTERS[w.raw], w.start), n)
                for key, a, b in runs(doc * len(m.languages) + label):
                    i = key // len(m.languages)
                    spans[i].append({"lang": m.languages[key % len(m.languages)], "start": a - int(w.first[i]), "end": b - int(w.first[i])})
                for i in range(n):
                    if total[i] and (ascii_letters[i] or LETTER.search(texts[i].as_py())):
                        pred[i], score[i] = m.languages[best[i]], share[i, best[i]] / total[i]
                    else:
                        spans[i] = []
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "lang_pred": pred, "score": score, "spans": pa.array(spans, pa.list_(span))})

    found = plain_documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>")
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "spans")
