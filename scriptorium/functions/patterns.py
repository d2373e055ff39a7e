"""Patterns compiled on the driver: names in spite of accents, flexible blanks, guards against bad input."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years of the sources' literature.
YEAR = r"(1[4-9]\d{2}|20\d{2})"
CAPITAL = r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\.\-]{1,}"


def _variants() -> dict[str, str]:
    """Latin letters that decompose to a base letter, by base letter."""
    found: dict[str, str] = {}
    for code in (*range(0xC0, 0x180), 0x1E9E):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            found[base] = found.get(base, base) + chr(code)
    return found | {"s": found.get("s", "s") + "ß", "S": found.get("S", "S") + "ẞ"}


VARIANTS = _variants()


def accents_allowed(word: str) -> str:
    """A regex for a word with or without accents; a hyphen may be blanks."""
    return "".join(f"[{VARIANTS[c]}]" if c in VARIANTS else r"[-\s]+" if c == "-" else re.escape(c) for c in word)


def surname_patterns(surname: str) -> list[str]:
    """`Surname, First`, `First Surname`, and `Surname` with a year within thirty characters."""
    s = accents_allowed(surname)
    return [rf"\b{s}\b\s*,\s*{CAPITAL}", rf"\b{CAPITAL}\s+{s}\b", rf"\b{s}\b[^\n]{{0,30}}\b{YEAR}\b"]


def flexible_blanks(alias: str) -> str:
    return re.sub(r"\s+", lambda _: "[\\s \\-]+", alias)


def usable(patterns: list[str], *, escape: bool = False) -> list[str]:
    """Patterns that compile; the others are left out, or taken literally."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
            out.append(p)
        except re.error:
            if escape:
                out.append(re.escape(p))
    return out


def usable_in_java(spark, patterns: list[str], *, escape: bool = False) -> list[str]:
    """Patterns that Spark's own regex functions take (Java's syntax); the others are left out, or taken literally."""
    from pyspark.errors import IllegalArgumentException

    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    out = []
    for p in patterns:
        try:
            compiler.compile(p)
            out.append(p)
        except IllegalArgumentException:
            if escape:
                out.append(compiler.quote(p))
    return out


def filename_author(name: Column) -> Column:
    """The surname of `Surname, First`, else the first capitalised words, else the first 40 characters."""
    base = F.translate(F.regexp_replace(name, r"\.[^.]+$", ""), "–", "-")
    part = F.trim(F.element_at(F.split(base, r"[_\-]"), 1))
    word = r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]+"
    options = [F.regexp_extract(base, rf"^({word}),\s*[A-ZÄÖÜ]", 1), F.regexp_extract(part, rf"^{word}(?:\s+{word})?", 0), F.left(part, F.lit(40)), F.left(base, F.lit(40))]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def filename_display(name: Column) -> tuple[Column, Column]:
    """id and `Last, First` of a file named first-last__id.pdf."""
    left = F.trim(F.translate(F.element_at(F.split(F.regexp_replace(name, r"\.[^.]+$", ""), "__"), 1), "_", "-"), F.lit("-"))
    parts = F.filter(F.split(left, "-"), lambda p: p != "")
    last = F.initcap(F.try_element_at(parts, F.lit(-1)))
    firsts = F.array_join(F.transform(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) > 1), F.initcap), " ")
    return left, F.when(F.size(parts) == 0, "Unbekannt").when(firsts == "", last).otherwise(F.concat(last, F.lit(", "), firsts))


def surname_on_page(folded_text: Column, surnames: Column) -> Column:
    """The cheap test before any regex: some folded surname stands in the folded text."""
    return F.exists(surnames, lambda s: F.contains(folded_text, s))
