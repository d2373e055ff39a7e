"""Quality rules: base rules on words, and robust outliers by minimum-covariance-determinant estimates.

For each language and source, the location and scatter of transformed text statistics come from the
minimum covariance determinant in its nested form for large groups: every group is dealt into subsets of
about SUBSET rows by a hash of id and statistics; concentration steps run to their end in each subset; the pooled
half-samples, which are a half-sample of the group, start two more steps over all rows of the group. No
task ever holds a group, and between the tasks go only sums. Rows whose Mahalanobis distance exceeds the
chi-square quantile are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, U, Words, bounded_batches, mix, plain_documents, staged, steps

FEATURES = ("log_words", "word_length", "symbols", "repeats", "lines", "distinct")
P = len(FEATURES)
SUBSET = 1000
#: Share of rows that the estimates rest on.
HALF = 0.75
#: Groups of fewer rows are pooled with the like of their language, and then with all.
LEAST = 100
#: What scales the scatter of the nearest HALF of normal rows to that of all: HALF over the chi-square share of eight degrees of freedom at 7.8408, the HALF quantile of six.
CONSISTENCY = 1.3616
#: Least standard deviation that counts. It stands in where the nearest rows hardly vary: most texts have no symbol and few repeats.
FLOOR = np.array([0.1, 0.02, 0.08, 0.12, 0.1, 0.05])
#: Chi-square quantile of six degrees of freedom at 1 - 1e-4: one clean row in 10,000 goes if the statistics are normal.
CUT = 27.86
MOMENTS = 1 + P + P * P
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules, and the distinct words and lines with a word, for each text."""
    w = Words(texts, BLANKS, lower=False)
    raw, at, n = w.raw, w.at, len(w.at) - 1
    doc, counts = w.doc(), w.counts()
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = np.bincount(doc, (heads[w.end] - heads[w.start]), n)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])
    # Windows of three words: those whose hash recurs in the text mark their words.
    three = np.flatnonzero(np.arange(len(w.hash)) + 3 <= np.repeat(w.first[1:], counts))
    h = mix((w.hash[three] * U(3) + w.hash[three + 1]) * U(0x9E3779B97F4A7C15) + w.hash[three + 2])
    key = (doc[three].astype(U) << U(48)) | (h >> U(16))
    _, back, often = np.unique(key, return_inverse=True, return_counts=True)
    again = three[often[back] > 1]
    marked = np.zeros(len(w.hash) + 2, bool)
    for j in range(3):
        marked[again + j] = True
    repeat = np.bincount(doc, marked[: len(doc)], n)
    distinct = np.bincount((np.unique((doc.astype(U) << U(48)) | (w.hash >> U(16))) >> U(48)).astype(np.int64), minlength=n)
    # Lines with a word, as bytes between line feeds.
    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    start = start[start < len(raw)]
    end = np.append(start[1:], len(raw))
    text_of = np.searchsorted(at, start, side="right") - 1
    end = np.where((end > start) & (raw[np.maximum(end - 1, 0)] == 10), end - 1, end)
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    data = raw.tobytes()
    dup, lines, seen, last = np.zeros(n, np.int64), np.zeros(n, np.int64), set(), -1
    for i, a, b in zip(text_of[has].tolist(), start[has].tolist(), end[has].tolist(), strict=True):
        if i != last:
            seen, last = set(), i
        line = data[a:b]
        if line in seen:
            dup[i] += 1
        seen.add(line)
        lines[i] += 1
    ints = {"n_words": counts, "word_chars": chars, "n_symbols": symbols[at[1:]] - symbols[at[:-1]], "n_dup_lines": dup, "n_repeat_words": repeat, "distinct": distinct, "lines": lines}
    return {k: np.asarray(v).astype(np.int64) for k, v in ints.items()}


def transformed(s: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as vectors: logarithms of sizes, arcsine roots of shares. Distinct words are set against what their number lets expect."""
    n = np.maximum(s["n_words"], 1)
    share = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.stack(
        [np.log(n), np.log(np.maximum(s["word_chars"], 1) / n), share(s["n_symbols"] / np.maximum(s["word_chars"], 1)), share(s["n_repeat_words"] / n), np.log1p(s["lines"]) - 0.5 * np.log(n), share(s["distinct"] / n) + 0.12 * np.log(n)],
        axis=1,
    )


def moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])


def shape(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance from a half-sample's moments, made consistent, the variances not below their floors."""
    n = max(m[0], 1)
    mean = m[1 : 1 + P] / n
    cov = CONSISTENCY * (m[1 + P :].reshape(P, P) / n - np.outer(mean, mean))
    return mean, np.linalg.inv(cov + np.diag(np.maximum(0, FLOOR**2 - np.diag(cov))))


def distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, inverse, d)


def concentrate(x: np.ndarray, steps: int = 30) -> np.ndarray:
    """Moments of the half-sample of x that concentration steps from the median and the median deviation end with."""
    half = max(1, int(np.ceil(HALF * len(x))))
    mean = np.median(x, axis=0)
    inverse = np.diag(1 / np.maximum(1.4826 * np.median(np.abs(x - mean), axis=0), FLOOR) ** 2)
    chosen = None
    for _ in range(steps):
        nearest = np.sort(np.argsort(distances(x, mean, inverse), kind="stable")[:half])
        if chosen is not None and np.array_equal(nearest, chosen):
            break
        chosen = nearest
        mean, inverse = shape(moments(x[chosen]))
    return moments(x[chosen])


BINS = 512


def _bin(d2: np.ndarray) -> np.ndarray:
    """Distances by a fine logarithmic scale."""
    return np.clip(np.floor(np.log2(np.maximum(d2, 1e-9)) * 24) + 256, 0, BINS - 1).astype(np.int64)


def _summed(df: DataFrame) -> DataFrame:
    """Sum of the moment arrays of each group, term by term."""
    return df.groupBy("grp").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(MOMENTS)]).select("grp", F.array(*[f"m{i}" for i in range(MOMENTS)]).alias("m"))


def statistics(docs: DataFrame, language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, grp parts, base counts, base_failed and the vector x of each row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            s = base_statistics(piece.column("text"))
            x = transformed(s)
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            own = {n: piece.column(n) for n in ("doc_id", "language", "source")}
            yield pa.RecordBatch.from_pydict(own | {k: s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": failed, "x": pa.array(list(x), pa.list_(pa.float64()))})

    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), known(language)("language"), known(source)("source"))
    return named.mapInArrow(run, f"doc_id long, language string, source string, {BASE}, base_failed boolean, x array<double>")


def quality(docs: DataFrame, *, language: str = "lang", source: str = "source", cut: float = CUT) -> DataFrame:
    """Base counts, base_failed, kept and the squared distance of each row of docs.

    Words are runs of anything but ASCII white space; a null text has none. Rows that fail the base rules
    are never kept and have no part in the estimates. Groups of fewer than LEAST rows that pass are pooled
    by language, then over all; where even those are fewer, nothing is an outlier. A null language or
    source is one like any other. Repeated rows count and come back each time. No rows: no rows.
    """
    rows = staged(statistics(docs, language, source), "statistics")
    passed = F.col("base_failed") == F.lit(False)
    sizes = rows.where(passed).groupBy("language", "source").agg(F.count("*").alias("n"))
    by_language = Window.partitionBy("language")
    small = F.col("n") < LEAST
    pooled = sizes.withColumn("rest", F.sum(F.when(small, F.col("n")).otherwise(0)).over(by_language))
    grp = F.when(~small, F.to_json(F.struct("language", "source"))).when(F.col("rest") >= LEAST, F.to_json(F.struct("language"))).otherwise("{}")
    named = staged(pooled.select("language", "source", "n", grp.alias("grp")), "groups")
    totals = named.groupBy("grp").agg(F.sum("n").alias("n"))
    keys = named.drop("n").join(totals, "grp").where((F.col("grp") != "{}") | (F.col("n") >= LEAST))
    fit = rows.where(passed).join(keys, ["language", "source"]).select("grp", "n", "x", "doc_id")

    def subset(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("doc_id")["x"].to_numpy())
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "m": [concentrate(x)]})

    dealt = fit.withColumn("part", F.pmod(F.xxhash64("doc_id", "x"), F.ceil(F.col("n") / SUBSET)))
    start = staged(_summed(dealt.groupBy("grp", "part").applyInPandas(subset, "grp string, m array<double>")), "start")
    for _ in range(2):
        start = _full_step(fit, start, totals)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d2 = _distances(b)
            failed = b.column("base_failed").to_numpy(zero_copy_only=False)
            names = [n for n in b.schema.names if n not in ("x", "m")]
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in names} | {"kept": ~failed & ~(d2 > cut), "distance": pa.array(d2, from_pandas=True)})

    params = named.select("language", "source", "grp").join(start, "grp").drop("grp")
    judged = rows.join(params, ["language", "source"], "left").select("doc_id", *[c.split()[0] for c in BASE.split(", ")], "base_failed", "x", "m")
    return judged.mapInArrow(verdict, f"doc_id long, {BASE}, base_failed boolean, kept boolean, distance double")


def _distances(batch: pa.RecordBatch) -> np.ndarray:
    """Squared distances of rows from the estimates beside them; NaN without estimates."""
    x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
    m = batch.column("m").to_pylist()
    shapes: dict[tuple, tuple] = {}
    out = np.full(len(x), np.nan)
    groups: dict[tuple, list[int]] = {}
    for i, own in enumerate(m):
        if own is not None:
            groups.setdefault(tuple(own), []).append(i)
    for own, at in groups.items():
        if own not in shapes:
            shapes[own] = shape(np.array(own))
        out[at] = distances(x[at], *shapes[own])
    return out


def _full_step(fit: DataFrame, params: DataFrame, totals: DataFrame) -> DataFrame:
    """One concentration step over all rows: the nearest share of each group, up to the edge of a fine bin of distances."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"grp": b.column("grp"), "bin": _bin(_distances(b)), "x": b.column("x")})

    # A row for each group, task and bin: the counts and moments of a bin are enough for any cut at its edge.
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in binned(batches):
            grp, at, x = np.array(b.column("grp").to_pylist(), object), b.column("bin").to_numpy(), np.stack(b.column("x").to_numpy(zero_copy_only=False))
            names, code = np.unique(grp, return_inverse=True)
            key = code * BINS + at
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for own in np.split(order, cuts):
                k = (names[code[own[0]]], int(at[own[0]]))
                held[k] = held.get(k, 0) + moments(x[own])
        if held:
            yield pa.RecordBatch.from_pydict({"grp": [g for g, _ in held], "bin": [b for _, b in held], "m": pa.array(list(held.values()), pa.list_(pa.float64()))})

    parts = fit.join(params, "grp").select("grp", "x", "m").mapInArrow(sums, "grp string, bin long, m array<double>")
    bins = parts.groupBy("grp", "bin").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(MOMENTS)])
    before = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = bins.withColumn("before", F.coalesce(F.sum("m0").over(before), F.lit(0.0))).join(totals, "grp").where(F.col("before") < F.col("n") * HALF)
    return staged(_summed(inside.select("grp", F.array(*[f"m{i}" for i in range(MOMENTS)]).alias("m"))), "step")
