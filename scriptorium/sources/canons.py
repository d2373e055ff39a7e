"""Canons and staging: authors, works and chronicles from JSON, pattern tables with fallbacks, staged lines, SQLite files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LIST = "array<string>"
#: Rows of a SQLite table that one task reads.
SQLITE_ROWS = 50_000


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(LIST))


def authors_canon(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, author_id, display, filename_aliases, text_aliases, negatives, merge_into; entries without an id are left out."""
    entry = f"struct<canonical_id: string, display: string, filename_aliases: {LIST}, text_aliases: {LIST}, negatives: {LIST}, merge_into: string>"
    raw = spark.read.option("multiLine", True).schema(f"authors array<{entry}>").json(path)
    e = raw.select(F.posexplode("authors").alias("ordinal", "e")).select("ordinal", "e.*")
    return e.withColumn("canonical_id", F.trim("canonical_id")).where("canonical_id != ''").select("ordinal", F.col("canonical_id").alias("author_id"), "display", *[_list(F.col(c)).alias(c) for c in ("filename_aliases", "text_aliases", "negatives")], F.nullif(F.trim("merge_into"), F.lit("")).alias("merge_into"))


def works_canon(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, canonical, author, year (null if it is no number), aliases, negatives; entries without a name are left out."""
    raw = spark.read.option("multiLine", True).schema(f"works array<struct<canonical: string, author: string, year: string, aliases: {LIST}, negatives: {LIST}>>").json(path)
    e = raw.select(F.posexplode("works").alias("ordinal", "e")).select("ordinal", "e.*")
    return e.withColumn("canonical", F.trim("canonical")).where("canonical != ''").select("ordinal", "canonical", "author", F.col("year").try_cast("int").alias("year"), _list(F.col("aliases")).alias("aliases"), _list(F.col("negatives")).alias("negatives"))


def canon_patterns(tables: dict[str, DataFrame]) -> DataFrame:
    """label, grp, pattern, weight: of chronicles; where there is no such table of works_json; else of works_canon; else an error.

    Generic terms come on top, from `generic_terms` (patterns, or lists of aliases) or else `generic_patterns`.
    Lists that are no JSON lists are empty. A group's weight is the last positive one of its rows, 1 without one.
    """
    lists = lambda c: F.explode(_list(F.from_json(F.coalesce(c, F.lit("[]")), LIST)))
    or_work = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("work"))
    weights = None
    if "chroniken_canon" in tables:
        rows = tables["chroniken_canon"].select(or_work(F.col("kind")).alias("grp"), or_work(F.col("label")).alias("label"), "patterns_json", F.col("weight").try_cast("double").alias("weight"))
        found = rows.select("label", "grp", lists(F.col("patterns_json")).alias("pattern"))
        weights = rows.where("weight > 0").groupBy("grp").agg(F.last("weight").alias("weight"))
    else:
        name, label = next(((n, c) for n, c in (("works_json", "json_canonical"), ("works_canon", "canonical")) if n in tables), (None, None))
        if name is None:
            raise ValueError("neither chroniken_canon nor works_json nor works_canon")
        found = tables[name].select(or_work(F.col(label)).alias("label"), F.lit("work").alias("grp"), lists(F.col("aliases_json")).alias("pattern"))
    generic = tables.get("generic_terms", tables.get("generic_patterns"))
    if generic is not None:
        own = F.col("pattern") if "pattern" in generic.columns else lists(F.col("aliases_json"))
        found = found.union(generic.select(F.lit("generic").alias("label"), F.lit("generic").alias("grp"), own.alias("pattern")))
    found = found.where("pattern != ''")
    return (found.join(weights, "grp", "left") if weights is not None else found.withColumn("weight", F.lit(None).cast("double"))).select("label", "grp", "pattern", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def staged_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as columns; lines that are no JSON objects are left out."""
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.trim("value").alias("value"))
    return parsed.where(F.col("value").startswith("{") & F.try_parse_json("value").isNotNull()).select("r.*")


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a SQLite file in a folder that all executors see, read-only, in ranges of row ids."""
    columns = spark.createDataFrame([], schema).columns
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
    source = '"' + name.replace('"', '""') + '"'

    def rows(sql: str, *values) -> list[tuple]:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            return con.execute(sql, values).fetchall()
        finally:
            con.close()

    lo, hi = rows(f"SELECT min(rowid), max(rowid) FROM {source}")[0]
    if lo is None:
        return spark.createDataFrame([], schema)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first in pdf["id"]:
                yield pd.DataFrame(rows(f"SELECT {quoted} FROM {source} WHERE rowid BETWEEN ? AND ?", int(first), int(first) + SQLITE_ROWS - 1), columns=columns)

    ranges = spark.range(lo, hi + 1, SQLITE_ROWS)
    return ranges.mapInPandas(read, schema)


def terms_list(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a list with or without the heading `term`, one to a line, the first field if there are several; each once, in lower case."""
    first = F.trim(F.regexp_replace(F.element_at(F.split(F.regexp_replace("value", "^﻿", ""), "[,;\t]"), 1), '^"|"$', ""))
    return spark.read.text(path).select(F.lower(first).alias("term")).where("term not in ('', 'term')").distinct()


def label_of(canonical: Column) -> Column:
    """The name before the first parenthesis, without quotes around it and commas at its ends."""
    head = F.trim(F.substring_index(canonical, "(", 1))
    plain = F.when((F.length(head) >= 2) & head.startswith('"') & head.endswith('"'), F.trim(F.substring(head, F.lit(2), F.length(head) - 2))).otherwise(head)
    return F.regexp_replace(plain, "^[ ,]+|[ ,]+$", "")


def name_in_parentheses(c: Column) -> Column:
    """The normalised `Surname, First` in parentheses; null without one."""
    return F.nullif(T.normalize(F.regexp_extract(c, r"\(([^()]*,[^()]*)\)", 1)), F.lit(""))
