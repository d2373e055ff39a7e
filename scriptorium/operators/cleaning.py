"""Cleaning of scanned editions: page furniture, editors' lines, apparatus, hyphens, paragraphs of the chronicler."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _replaced

# Patterns of editions. Editors' words:
EDITORIAL = (
    r"\bEinleitung\b", r"\bVorrede\b", r"\bBeilage(n)?\b", r"\bRegister\b",
    r"\bInhaltsverzeichn", r"\bAnalekten\b", r"\bVariante(n)?\b", r"\bAnmerkung(en)?\b",
    r"\bDigitized\s+by\s+Google\b", r"\bBASLER\s+CHRONIKEN\b",
    r"\bWurstisen\b", r"\bTrouillat\b", r"\bHegel\b", r"\bStuder\b", r"\bMone\b",
    r"\bCod\.\b", r"\bMs\.\b|\bHs\.\b|\bHss\.\b", r"\bUrk\.\b|\bUrkundenb\.\b|\bUrk\b",
    r"\bSt\.\s*A\.\b", r"\bBd\.\b", r"\bS\.\s*\d+\b", r"\bAusg\.\b",
    r"\bBibliothek\b", r"\bTop\.\b", r"\bAnnalen\b", r"\bChron\.\b",
)
# Words that open a chronicle's paragraph, and its vocabulary:
OPENING = r"^(?:Anno|An\.|Item|Im\s+jare|Im\s+jar|In\s+dem\s+jare|In\s+dem\s+jar|Des\s+jares?|Des\s+jare|Do|Uff|Darnach|Hie|Also|Nach\s+dem|Darauf)\b"
ARCHAIC = (
    r"\bdo\b", r"\buff\b", r"\bze\b", r"\bhertzog", r"\bmarkgraf", r"\bbischof", r"\britter", r"\bknecht", r"\bgräf",
    r"\bgräve", r"\bburg\b", r"\bstatt\b", r"\bstett", r"\bküng", r"\bpapst", r"\bconcil", r"\bconcilium", r"\bhussit",
    r"\bfehde", r"\bfasnacht", r"\bjar", r"\bjare",
)
YEAR = r"\b(13|14)\d{2}\b"
# Lines that are page furniture:
FURNITURE = (r"^\s*\d+\s*$", r"^\s*[IVXLCDM]{1,8}\s*$", r"^\s*[—\-–]+\s*$", r"^\s*[A-ZÄÖÜ][A-ZÄÖÜ\s\.\-]{2,40}$")
LETTER_FURNITURE = (r"^\s*[A-ZÄÖÜ]\s*$", r"^\s*A\s*[IVXLCDM]+(\s*\([^)]+\))?\s*$", r"^\s*<\d{8,}>\s*$")
STAMPS = (r"^\s*Bayer(ische|\.)(\s+Staatsbibliothek)?\b.*$", r"^\s*BIBLIOTHECA\b.*MONACENSIS\b.*$", r"^\s*Oeco[nm]\.\b.*\d+\s*$")
BRACKETS = (r"\[[^\]\n]{1,200}\]", r"⟪[^⟫\n]{1,200}⟫", r"«[^»\n]{1,200}»")
# What a note in parentheses holds that belongs to the apparatus:
APPARATUS = (r"\bAnm\.", r"\bVgl\.", r"\bUrk", r"\bS\.\s*\d+", r"\bBd\.", r"\bChron\.", r"\d{3,4}")
FOOTNOTES = (r"\b\d+\)", r"\(\d+\)", r"[⁰¹²³⁴⁵⁶⁷⁸⁹]+", r"\^\d+", r"(?<=\w)\d{1,3}(?=[\s,.;:])")
PAGE_BREAK = r"(?m)^\s*-{2,}\s*\d+\s*/\s*\d+\s*-{2,}\s*$"
REGISTER = r"(?ms)^\s*Regi[sſ]ter\b.*?(?=^\s*-{2,}\s*\d+\s*/\s*\d+\s*-{2,}\s*$|\z)"


# Leading page or line numbers, words cut at a line's end, `vnd` and `vnnd`, and what tidying replaces:
LEADING_NUMBER = r"(?m)^[ \t]*\d{1,4}[ \t]+"
CUT_WORD = r"-\s*\n(?=\p{Ll})"
OLD_AND = r"\b[vV]n{1,2}d\b"
TIDY = ((r"[ \t]{2,}", " "), (r"\s+\n", "\n"), (r"\n{3,}", "\n\n"), (r"\s+([,.;:!?])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"))


def _at_a_word(*patterns: str) -> str:
    """One regex for patterns that all begin at a word boundary, which is so tested once for each place."""
    ways = [w for p in patterns for w in p.split("|")]
    assert all(w.startswith(r"\b") for w in ways)
    return r"(?iU)\b(?:" + "|".join(w.removeprefix(r"\b") for w in ways) + ")"


def _without(c: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, f"(?U){p}", ""), patterns, c)


def _kept_lines(c: Column, drop) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~drop(line)), "\n")


def is_furniture(line: Column, patterns: tuple[str, ...] = FURNITURE) -> Column:
    return F.trim(line).rlike("|".join(patterns))


def is_editorial(text: Column) -> Column:
    return text.rlike(_at_a_word(*EDITORIAL))


def unhyphenated(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CUT_WORD, ""), "­", "")


def joined_paragraphs(c: Column) -> Column:
    """Paragraphs between empty lines, each on one line."""
    own = F.transform(F.split(c, r"\n{2,}"), lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")), r"[ \t]*\n[ \t]*", " "))
    return F.filter(own, lambda p: p != "")


def tidy(c: Column) -> Column:
    for pattern, new in TIDY:
        c = F.regexp_replace(c, pattern, new)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def editorial_paragraph(p: Column) -> Column:
    return is_editorial(p) | p.rlike(r"[\[\]]") | p.rlike(r"\([^)]*\d{2,4}[^)]*\)") | (F.regexp_count(p, F.lit(";")) >= 3)


def chronist_score(p: Column) -> Column:
    """2 for an opening, 2 for a year, 1 for the vocabulary, less 1 for many brackets."""
    one = lambda regex: p.rlike(f"(?iU){regex}").cast("int")
    return 2 * one(OPENING) + 2 * p.rlike(YEAR).cast("int") + p.rlike(_at_a_word(*ARCHAIC)).cast("int") - (F.regexp_count(p, F.lit(r"[()]")) > 2).cast("int")


def chronicle_paragraphs(text: Column) -> Column:
    """Paragraphs after all reductions, before the paragraph filter."""
    s = _replaced(text, {"ſ": "s", "ﬅ": "st", "ﬁ": "fi", "ﬂ": "fl"})
    s = F.regexp_replace(s, LEADING_NUMBER, "")
    s = _kept_lines(s, lambda line: is_furniture(line) | is_editorial(line))
    s = unhyphenated(_without(s, *BRACKETS, rf"\([^)]*(?:{'|'.join(APPARATUS)})[^)]*\)", *FOOTNOTES))
    return joined_paragraphs(s)


def clean_edition(text: Column) -> Column:
    """The chronicler's own paragraphs, those that score 2 or more."""
    kept = F.filter(chronicle_paragraphs(text), lambda p: ~editorial_paragraph(p) & (chronist_score(p) >= 2))
    return tidy(F.array_join(kept, "\n\n"))


def clean_print(text: Column, modern_and: bool = True) -> Column:
    """An early print: no register, page breaks, stamps or furniture; lines joined; vnd as und."""
    s = _replaced(text, {"ſ": "s", "ﬅ": "st", "ﬁ": "fi", "ﬂ": "fl", "­": ""})
    s = F.regexp_replace(F.regexp_replace(s, REGISTER, ""), PAGE_BREAK, "")
    s = _kept_lines(s, lambda line: line.rlike("(?i)" + "|".join(STAMPS)) | is_furniture(line, (*FURNITURE, *LETTER_FURNITURE)))
    s = F.array_join(joined_paragraphs(unhyphenated(F.regexp_replace(s, LEADING_NUMBER, ""))), "\n\n")
    return tidy(F.regexp_replace(s, OLD_AND, "und") if modern_and else s)
