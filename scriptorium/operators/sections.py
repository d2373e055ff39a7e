"""Sections of paged documents: bibliography pages, keyword blocks, page scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings that open a bibliography.
HEADINGS = (
    r"^\s*literatur\s*$",
    r"^\s*bibliographi[ea]\s*$",
    r"^\s*literaturverzeichnis\s*$",
    r"^\s*references\s*$",
    r"^\s*bibliography\s*$",
    r"^\s*quellen\s*(und\s*literatur)?\s*$",
)


def heading(text: Column) -> Column:
    return text.rlike("(?im)" + "|".join(f"(?:{h})" for h in HEADINGS))


def to_the_end(pages: DataFrame, doc: str, page: str, hit: Column) -> DataFrame:
    """in_bib: 1 from the first page that is hit to the document's last. The first page is reduced and joined, so no window holds a document."""
    first = pages.where(hit).groupBy(doc).agg(F.min(page).alias("_first"))
    return pages.join(first, doc, "left").withColumn("in_bib", F.coalesce((F.col(page) >= F.col("_first")).cast("int"), F.lit(0))).drop("_first")


def runs(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Contiguous runs of the pages given: doc, first, last, length."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page))
    named = pages.withColumn("_island", island)
    return named.groupBy(doc, "_island").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("length")).drop("_island")


def longest_run(pages: DataFrame, doc: str, page: str, least: int = 2) -> DataFrame:
    """Each document's longest run, the earliest of equally long ones."""
    best = F.max_by(F.struct("first", "last", "length"), F.struct("length", -F.col("first")))
    return runs(pages.select(doc, page).distinct(), doc, page).where(F.col("length") >= least).groupBy(doc).agg(best.alias("b")).select(doc, "b.first", "b.last", "b.length")


def scored_block(scores: DataFrame, doc: str, page: str, score: str, boost: float = 1.0) -> DataFrame:
    """The run of pages of at least the document's median score times boost with the highest mean; then the longer, then the earlier."""
    median = scores.groupBy(doc).agg((F.median(score) * boost).alias("_cut"))
    high = scores.join(median, doc).where(F.col(score) >= F.col("_cut"))
    island = F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page))
    blocks = high.withColumn("_island", island).groupBy(doc, "_island").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("length"), F.round(F.avg(score), 6).alias("mean_score"))
    best = F.max_by(F.struct("first", "last", "length", "mean_score"), F.struct("mean_score", "length", -F.col("first")))
    return blocks.groupBy(doc).agg(best.alias("b")).select(doc, "b.*")


def page_score(text: Column, header_weight: float = 2.0, cite_weight: float = 1.0) -> Column:
    """Bibliography words in the first eight lines, and the share of lines that look like references."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    head = F.array_join(F.slice(lines, 1, 8), "\n")
    title = head.rlike(r"(?i)\b(bibliograph\w*|references?|reference\s+list|works\s+cited|literaturverzeichnis|quellen(?:verzeichnis| und literatur)?)\b")
    caps, alpha = F.length(F.regexp_replace(head, r"[^\p{Lu}]", "")), F.greatest(F.length(F.regexp_replace(head, r"[^\p{L}]", "")), F.lit(1))
    cites = F.size(F.filter(lines, lambda x: x.rlike(r"10\.\d{4,}/|^\s*\[\d+\]|\((1[4-9]|20)\d{2}\)|\b(1[4-9]|20)\d{2}\b")))
    return header_weight * (title & (caps / alpha >= 0.45)).cast("double") + cite_weight * cites / F.greatest(F.size(lines), F.lit(1))


def head_and_tail(pages: DataFrame, doc: str, page: str, head: float = 0.05, tail: float = 0.25) -> DataFrame:
    """The pages of the first and last fractions of each document."""
    n = pages.groupBy(doc).agg(F.max(page).alias("_n"))
    return pages.join(n, doc).where((F.col(page) <= F.ceil(F.col("_n") * head)) | (F.col(page) > F.col("_n") - F.ceil(F.col("_n") * tail))).drop("_n")


def last_toc_entry(toc: DataFrame, doc: str, ordinal: str, title: str, page: str) -> DataFrame:
    """first and last page by the table of contents: a bibliography entry that is the last one reaches to the end (null)."""
    hit = toc.where(F.col(title).rlike(r"(?i)\b(bibliograph\w*|references?|literaturverzeichnis|quellen)\b"))
    last = toc.groupBy(doc).agg(F.max(ordinal).alias("_last"))
    found = hit.groupBy(doc).agg(F.max_by(F.struct(ordinal, page), ordinal).alias("h"))
    return found.join(last, doc).select(doc, F.col(f"h.{page}").alias("first"), F.when(F.col(f"h.{ordinal}") == F.col("_last"), None).otherwise(F.col(f"h.{page}")).alias("last"))


def heading_votes(spans: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """(font, text) pairs that recur and are larger than the document's most frequent size."""
    sizes = spans.groupBy(doc, "size").agg(F.count("*").alias("n")).groupBy(doc).agg(F.max_by("size", F.struct("n", "size")).alias("_body"))
    return spans.groupBy(doc, "font", "text").agg(F.count("*").alias("votes"), F.max("size").alias("size")).where(F.col("votes") >= least).join(sizes, doc).where("size > _body").drop("_body")
