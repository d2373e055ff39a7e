"""Sentences that need a citation: tags, reuse of earlier decisions, footnote marks, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reused(current: DataFrame, previous: DataFrame, paragraph: str, sentence: str, flag: str) -> DataFrame:
    """current with the flag of the same sentence in the same paragraph before: the n-th occurrence takes the n-th flag; new ones have none."""
    nth = F.row_number().over(Window.partitionBy(paragraph, sentence).orderBy("ordinal"))
    a, b = current.withColumn("_nth", nth), previous.withColumn("_nth", nth)
    return a.join(b.select(paragraph, sentence, "_nth", F.col(flag).alias("_flag")), [paragraph, sentence, "_nth"], "left").withColumn(flag, F.col("_flag")).withColumn("is_new", F.col("_flag").isNull()).drop("_flag", "_nth")


def same_paragraphs(current: DataFrame, previous: DataFrame, doc: str, index: str, text: str) -> DataFrame:
    """doc, index, previous_index: the paragraph of an earlier report that each paragraph goes on from.

    The one with its index; where there is none, one with the same text: the n-th such paragraph takes the n-th
    of the report. Paragraphs without either have no row. Both tables hold a (doc, index) once.
    """
    by_index = current.select(doc, index).join(previous.select(doc, index), [doc, index]).withColumn("previous_index", F.col(index))
    nth = F.row_number().over(Window.partitionBy(doc, text).orderBy(index))
    left = current.join(by_index.select(doc, index), [doc, index], "left_anti").withColumn("_nth", nth)
    same = previous.select(doc, text, F.col(index).alias("previous_index"), nth.alias("_nth"))
    return by_index.unionByName(left.join(same, [doc, text, "_nth"]).select(doc, index, "previous_index"))


def markup(key: Column, note: Column) -> Column:
    """` [prefix @key, pp. pages]`: what precedes the first digit is the prefix, the rest the pages."""
    k, text = F.trim(key), F.trim(F.coalesce(note, F.lit("")))
    has_digit = text.rlike(r"\d")
    clean = lambda c: F.regexp_replace(c, r"^[ ,;:]+|[ ,;:]+$", "")
    prefix, pages = clean(F.regexp_extract(text, r"^(\D*)", 1)), clean(F.regexp_extract(text, r"(\d.*)$", 1))
    with_prefix = F.concat(F.lit(" ["), prefix, F.lit(" @"), k, F.lit(", pp. "), pages, F.lit("]"))
    without = F.concat(F.lit(" [@"), k, F.lit(", pp. "), pages, F.lit("]"))
    plain = F.concat(F.lit(" ["), text, F.lit(" @"), k, F.lit("]"))
    return F.when(k == "", "").when(text == "", F.concat(F.lit(" [@"), k, F.lit("]"))).when(~has_digit, plain).when(prefix != "", with_prefix).otherwise(without)


def paragraphs(sentences: DataFrame, paragraph: str, ordinal: str, text: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(ordinal, text)))
    return sentences.groupBy(paragraph).agg(F.array_join(F.transform(listed, lambda s: s[text]), " ").alias("paragraph_text"))
