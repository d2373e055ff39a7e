"""Mentions of canon entries in texts: counts, spans with context, negatives, summaries, co-mention."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.literals import Candidates

SPANS = "ordinal int, start int, end int, matched string"
#: Texts whose matches one batch holds.
TEXTS = 256


def token_mentions(docs: DataFrame, canon: DataFrame, *keep: str, id_col: str = "doc_id") -> DataFrame:
    """Occurrences of one-word labels: a row for each document and label, with cnt.

    The canon is a constant list, so it is broadcast; tokens are reduced before the shuffle.
    """
    tokens = docs.select(id_col, *keep, F.explode(T.words(F.col("text"))).alias("label"))
    return tokens.join(F.broadcast(canon), "label").groupBy(id_col, *keep, *canon.columns).agg(F.count("*").alias("cnt"))


def regex_mentions(docs: DataFrame, patterns: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Occurrences of pattern rows (label, grp, regex) by a theta join with a constant list; regexes match Unicode words, any case."""
    joined = docs.select(id_col, "text").join(F.broadcast(patterns), F.expr("text RLIKE concat('(?iU)', regex)"))
    return joined.select(id_col, "label", "grp", F.expr("regexp_count(text, concat('(?iU)', regex))").alias("cnt"))


def find_spans(docs: DataFrame, patterns: list[str], *keep: str, text_col: str = "text", first_only: bool = True) -> DataFrame:
    """A row for each match of each pattern: ordinal of the pattern, code-point span, matched text.

    Patterns that don't compile are left out. With first_only, a span that an earlier pattern has found isn't
    found again. One pass over a text tells which patterns may match it; only these are tried.
    """
    compiled = []
    for i, p in enumerate(patterns):
        try:
            compiled.append((i, re.compile(p, re.IGNORECASE)))
        except re.error:
            continue
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def found(texts: list[str | None], candidates: Candidates) -> pa.ListArray:
        offsets, rows = [0], []
        for text in texts:
            seen = set()
            for i, p in map(compiled.__getitem__, candidates.of(text) if text else ()):
                for m in p.finditer(text):
                    if not first_only or m.span() not in seen:
                        seen.add(m.span())
                        rows.append((i, m.start(), m.end(), m[0]))
            offsets.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        fields = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["ordinal", "start", "end", "matched"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = Candidates([p.pattern for _, p in compiled])
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found(part.column(text_col).to_pylist(), candidates)], names=[*keep, "_spans"])

    # what is kept goes through Python once for each text, not once for each match
    names = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*names).mapInArrow(run, f"{schema}_spans array<struct<{SPANS.replace(' ', ':').replace(',:', ', ')}>>").select(*keep, F.inline("_spans"))


def without_negatives(hits: DataFrame, negatives: list[str], context_col: str = "context") -> DataFrame:
    out = hits
    for n in negatives:
        out = out.where(~F.coalesce(F.col(context_col).rlike(f"(?iU){n}"), F.lit(False)))
    return out


def with_required_context(hits: DataFrame, required: Column, context_regex: str, context_col: str = "context") -> DataFrame:
    return hits.where(~required | F.col(context_col).rlike(f"(?iU){context_regex}"))


def sampled(hits: DataFrame, per: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return hits.withColumn("_nth", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def distinct_hits(hits: DataFrame) -> DataFrame:
    return hits.dropDuplicates()


def summary(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """mentions, docs and weighted mentions of each label."""
    return hits.groupBy("grp", "label", "weight").agg(F.sum("cnt").alias("mentions"), F.count_distinct(id_col).alias("docs")).withColumn("weighted", F.col("mentions") * F.col("weight")).drop("weight")


def co_mentions(pairs: DataFrame, doc_col: str, label_col: str) -> DataFrame:
    """Documents that hold both of two labels, once for each pair; a document's labels are a set of the canon."""
    one = pairs.select(F.col(doc_col).alias("d"), F.col(label_col).alias("l")).distinct()
    sets = one.groupBy("d").agg(F.sort_array(F.collect_set("l")).alias("ls"))
    a = sets.select("ls", F.posexplode("ls").alias("i", "a"))
    both = a.select("a", F.explode(F.slice("ls", F.col("i") + 2, F.greatest(F.size("ls") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("weight"))


def first_by_filename(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first author (by ordinal) one of whose alias regexes a file name matches, after merge_into."""
    hit = files.join(F.broadcast(aliases), F.expr("name RLIKE concat('(?iU)', alias)"))
    first = hit.groupBy("name").agg(F.min_by(F.coalesce("merge_into", "author_id"), "ordinal").alias("author_id"))
    return files.join(first, "name", "left")
