"""Concept families: variants, totals, co-occurrence, pivots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .mentions import find_spans

# Categories of the lexicon.
CATEGORIES = ("core_peace", "truce", "settlement", "legal_instrument", "end_of_hostilities")
# The patterns of the lexicon by category; those in AMBIGUOUS count only near a word of CONTEXT.
LEXICON = (
    ("core_peace", r"frieden[srm]?"), ("core_peace", r"friden[srm]?"), ("core_peace", r"pax(?:is|em|e|i)?"),
    ("core_peace", r"concord(?:ia|iae|iam|ias|is|at(?:io|ionis|iones)?)"), ("core_peace", r"reconcili(?:atio(?:nes)?|ation|are|atio|atus|e?\w*)"),
    ("truce", r"waffenstillstand"), ("truce", r"waffenruhe"), ("truce", r"feuerpause"), ("truce", r"induci(?:ae|arum|as|is|a)"), ("truce", r"treug(?:a|ae|arum|is|as)"),
    ("settlement", r"vergleich\w*"), ("settlement", r"sühne\w*|suehne\w*"), ("settlement", r"versöhn\w*|versoehn\w*"), ("settlement", r"einigung\w*"),
    ("settlement", r"einung\w*"), ("settlement", r"schlicht\w*"), ("settlement", r"schiedsspruch\w*"), ("settlement", r"invernehmen"),
    ("legal_instrument", r"landfrieden\w*"), ("legal_instrument", r"vertrag\w*"), ("legal_instrument", r"pact\w*|pakt\w*"), ("legal_instrument", r"abkommen\w*"),
    ("legal_instrument", r"abschied\w*"), ("legal_instrument", r"bündnis\w*|buendnis\w*"), ("legal_instrument", r"bund(?!es)\w*"),
    ("end_of_hostilities", r"beendig\w*"), ("end_of_hostilities", r"einstellung\w*"), ("end_of_hostilities", r"beilegen\w*|beigelegt\w*|beilegt\w*"),
    ("end_of_hostilities", r"kapitulation\w*"), ("end_of_hostilities", r"fristfrieden\w*"),
    ("core_peace", r"peace"), ("truce", r"truce"), ("truce", r"cease[-\s]?fire|ceasefire"), ("end_of_hostilities", r"cessation of hostilities"),
    ("settlement", r"settlement"), ("settlement", r"reconciliation"), ("legal_instrument", r"treaty|accord|pact"),
)
AMBIGUOUS = (r"abschied\w*", r"bündnis\w*|buendnis\w*", r"bund(?!es)\w*", r"beendig\w*", r"einstellung\w*", r"beilegen\w*|beigelegt\w*|beilegt\w*")
CONTEXT = (
    r"frieden", r"krieg", r"kriegs", r"kriege", r"kampf\w*", r"feindselig\w*", r"waffen\w*", r"vertrag\w*", r"beschluss\w*", r"beschieden", r"vereinbar\w*",
    r"schließ\w*|schliess\w*", r"schluss\w*", r"tagsatzung\w*", r"landfrieden\w*", r"zwischen", r"zu", r"von",
)


def lexicon(spark: SparkSession, *, strict: bool = False) -> DataFrame:
    """ordinal, category, name, regex, needs_context. As used so far, only the outer ends of `a|b` are at a word's edge; strict: all are."""
    wrap = r"\b(?:{})\b" if strict else r"\b{}\b"
    rows = [(i, category, p, wrap.format(p), p in AMBIGUOUS) for i, (category, p) in enumerate(LEXICON)]
    return spark.createDataFrame(rows, "ordinal int, category string, name string, regex string, needs_context boolean")


def lexicon_hits(docs: DataFrame, *keep: str, strict: bool = False, width: int = 160) -> DataFrame:
    """keep columns, category, name, start, end, context: terms of the lexicon in texts; ambiguous ones need a context word within width characters."""
    terms = lexicon(docs.sparkSession, strict=strict).orderBy("ordinal").collect()
    spans = find_spans(docs, [t["regex"] for t in terms], *keep, "text", first_only=False)
    of = F.broadcast(docs.sparkSession.createDataFrame([tuple(t) for t in terms], "ordinal int, category string, name string, regex string, needs_context boolean"))
    context = T.squeeze(F.substring("text", F.greatest(F.lit(1), F.col("start") - width + 1), F.col("end") - F.col("start") + F.least(F.col("start"), F.lit(width)) + width))
    near = F.col("context").rlike(r"(?iU)\b(?:" + "|".join(f"(?:{c})" for c in CONTEXT) + r")\b")
    return spans.withColumn("context", context).join(of, "ordinal").where(~F.col("needs_context") | near).select(*keep, "category", "name", "start", "end", "context")


def variants(word: str) -> list[str]:
    """Endings after a consonant; stems of words in -en, -eln, -ern."""
    out = {word}
    if re.search(r"[b-df-hj-np-tv-z]$", word, re.IGNORECASE):
        out |= {word + e for e in ("e", "en", "es", "er")}
    if word.endswith(("en", "eln", "ern")):
        out |= {word[:-2], word[:-1]}
    return sorted(out)


def family_regex(words: list[str]) -> str:
    """Whole words, longer ones first."""
    return r"\b(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (len(w), w), reverse=True)) + r")\b"


# Letters that older German takes for one another.
HISTORIC = {"s": "sſ", "S": "Ssſ", "u": "uv", "U": "UV", "v": "uv", "V": "UV", "i": "ijy", "I": "IJY", "j": "ijy", "J": "IJY", "y": "ijy", "Y": "IJY", "k": "kc"}


def historic_literal(word: str) -> str:
    """A regex for a plain word with the spellings of older German."""
    return "".join(f"[{HISTORIC[c]}]" if c in HISTORIC else re.escape(c) for c in word)


def historic_name(name: str) -> str:
    """A regex for a plain name in older German, as a whole word, with any blanks between its words."""
    return rf"\b{r'\s+'.join(map(historic_literal, name.split()))}\b"


def zero_filled_pivot(hits: DataFrame, row: str, category: str, categories: tuple[str, ...], count: str = "cnt") -> DataFrame:
    return hits.groupBy(row).pivot(category, list(categories)).agg(F.sum(count)).na.fill(0)


def top_pivot_with_rest(hits: DataFrame, row: str, family: str, families: list[str], count: str = "cnt", rest: str = "Sonstige") -> DataFrame:
    """A column for each of the families given, and one for all others."""
    n = F.col(count)
    cells = [F.sum(F.when(F.col(family) == f, n).otherwise(0)).alias(f) for f in families]
    return hits.groupBy(row).agg(*cells, F.sum(F.when(~F.col(family).isin(*families), n).otherwise(0)).alias(rest))
