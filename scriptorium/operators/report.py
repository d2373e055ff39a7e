"""The report's query language: `group: label: file: pattern:` and free words, all of which must hold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("group", "label", "file", "pattern")


def parse(query: str) -> list[tuple[str, str]]:
    """(field or '', lower-case term) in order; a term in quotes may have blanks."""
    out = []
    for field, quoted, plain in re.findall(r'(?:(group|label|file|pattern):)?(?:"([^"]*)"|(\S+))', query):
        term = (quoted or plain).lower()
        if term:
            out.append((field, term))
    return out


def condition(query: str, columns: dict[str, str], fuzzy_label: bool = False) -> Column:
    """columns: the frame's column for each field. Free words may stand in any. A fuzzy label may be one edit or swap of neighbours away."""
    found = F.lit(True)
    for field, term in parse(query):
        names = [columns[field]] if field else list(columns.values())
        any_of = F.lit(False)
        for name in names:
            any_of = any_of | F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(term))
        if field == "label" and fuzzy_label:
            label = F.lower(F.col(columns["label"]))
            swapped = [term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)]
            any_of = any_of | (F.levenshtein(label, F.lit(term), 1) >= 0) | label.isin(swapped)
        found = found & any_of
    return found


def search(rows: DataFrame, query: str, columns: dict[str, str], fuzzy_label: bool = False) -> DataFrame:
    return rows.where(condition(query, columns, fuzzy_label))


def inverted_index(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """token, row id: the distinct tokens of the columns."""
    from ..functions.text import normalize_report

    text = F.concat_ws(" ", *columns)
    return rows.select(F.explode(F.array_distinct(F.filter(F.split(normalize_report(text), " "), lambda t: t != ""))).alias("token"), id_col)
