"""Text normalisations as Column builders; each keeps its own order of steps, as they differ in what they keep.

Accents are folded by translate() over the letters of Latin blocks, which stays in generated code;
`nfkd_fold` is the full Unicode form in Arrow batches for other alphabets.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that don't tell one chronicle from another.
STOPWORDS = ("chronik", "chronicon", "schweizerchronik", "geschichte", "geschichten", "berner", "zuercher", "zürcher", "luzerner", "eidgenossenschaft", "helveticum", "helvetica", "eidgenössische", "eidgenossische")


def _latin_folds() -> tuple[str, str]:
    """Letters with marks of the Latin blocks and their base letters, by their decomposition."""
    pairs = {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_MARKED, _BASE = _latin_folds()


def fold(c: Column) -> Column:
    """Without accents; combining marks go, case stays."""
    return F.regexp_replace(F.translate(c, _MARKED, _BASE), r"\p{Mn}", "")


@F.pandas_udf(StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Folded, lower case, single blanks."""
    return squeeze(F.lower(fold(c)))


def normalize_catalogue(c: Column) -> Column:
    """As normalize, null as empty, with typographic quotes made plain."""
    return normalize(F.translate(F.coalesce(c, F.lit("")), "‘’‚“”„´`", "''" + "'" + '"""' + "''"))


def key_tokens(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of letters and digits, folded, lower case. Texts of ASCII alone need no folding."""
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(fold(c))
    words = F.array_remove(F.split(F.lower(plain), "[^a-z0-9]+"), "")
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def canonical_key(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.array_join(key_tokens(c, stopwords), " ")


def token_set(c: Column, stopwords: tuple[str, ...] = STOPWORDS, least: int = 3) -> Column:
    words = F.array_distinct(key_tokens(c, stopwords))
    return F.filter(words, lambda w: F.length(w) >= least) if least > 1 else words


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def slugify(c: Column, longest: int | None = 64) -> Column:
    """Hyphenated letters and digits; `anon` if none is left. Without a length, the form of the network view (nothing for `anon`)."""
    s = F.regexp_replace(F.regexp_replace(F.lower(fold(F.trim(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if longest is None:
        return s
    cut = F.regexp_replace(F.left(s, F.lit(longest)), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "anon").otherwise(cut)


def _replaced(c: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Historical letters and ligatures of the finder.
HISTORICAL = {"­": "", "ſ": "s", "ꝛ": "r", "ꝝ": "v", "ꝯ": "o", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ﬃ": "ffi", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬅ": "ft", "ﬆ": "st", "ß": "ss"}


def normalize_finder(c: Column) -> Column:
    """Historical letters spelled out, words joined across line ends, no accents, single blanks; keeps case."""
    joined = F.regexp_replace(_replaced(c, HISTORICAL), r"(\p{L})-\s*\n\s*(\p{L})", "$1$2")
    return squeeze(fold(F.regexp_replace(joined, r"\r\n?|\n", " ")))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize_keyword(c: Column) -> Column:
    """Case-folded, single blanks; keeps umlauts."""
    return squeeze(casefold(c))


def normalize_term(c: Column) -> Column:
    """For comparing terms: umlauts spelled out, j as i, v as u."""
    return squeeze(F.translate(_replaced(casefold(c), {"ä": "ae", "ö": "oe", "ü": "ue"}), "jv", "iu"))


def normalize_search(c: Column) -> Column:
    return squeeze(F.replace(c, F.lit("ß"), F.lit("ss")))


def normalize_mhd(c: Column) -> Column:
    """Spelling of older German: no accents, u for v, i for j and y."""
    return squeeze(F.lower(F.translate(_replaced(fold(c), {"ſ": "s", "ß": "ss"}), "VvJjYy", "UuIiIi")))


def normalize_report(c: Column) -> Column:
    """For the report's index: letters and digits only, u as v, j as i."""
    words = F.regexp_replace(_replaced(fold(F.lower(c)), {"ß": "ss"}), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.translate(words, "uj", "vi"))


# Letters and spellings of early modern German.
MODERN_LETTERS = {"ſ": "s", "Æ": "Ae", "æ": "ae", "Œ": "Oe", "œ": "oe", "å": "a", "ů": "u", "ÿ": "y", "ẽ": "en", "õ": "on", "ã": "an", "ꝛ": "r"}
MODERN_WORDS = {"auff": "auf", "auffs": "aufs", "vnnd": "und", "vnd": "und", "vn": "und", "vber": "über", "ubir": "über", "eygentlich": "eigentlich"}


def modernize_letters(c: Column) -> Column:
    c = _replaced(c, MODERN_LETTERS)
    for old, new in MODERN_WORDS.items():
        c = F.regexp_replace(c, rf"(?iU)\b{old}\b", new)
    return c


def modernize_words(c: Column, words: dict[str, str]) -> Column:
    """Whole words replaced by a map, in upper or title case where the old word was."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])

    def one(token: Column) -> Column:
        new = F.try_element_at(table, F.lower(token))
        upper = (token == F.upper(token)) & (F.length(token) > 1)
        title = F.substring(token, 1, 1) == F.upper(F.substring(token, 1, 1))
        cased = F.when(upper, F.upper(new)).when(title, F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20))).otherwise(new)
        return F.coalesce(cased, token)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1)), one), "")


def words(c: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}", ""))


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{Nd}", ""))


def good_enough(c: Column) -> Column:
    """Enough letters for prose, or enough digits for a table."""
    n, a, d = F.length(c), letters(c), digits(c)
    prose = a >= F.greatest(F.lit(10), F.floor(n / 8))
    figures = (d >= 20) & (a + d >= F.greatest(F.lit(25), F.floor(n / 4)))
    return F.coalesce((n >= 30) & (prose | figures), F.lit(False))


def quality_score(c: Column) -> Column:
    """Share of letters, digits up to three tenths, and both, growing with length up to about 400."""
    n = F.greatest(F.length(c), F.lit(1))
    a, d = letters(c) / n, digits(c) / n
    score = (0.5 * a + 0.3 * F.least(F.lit(0.3), d) + 0.2 * (a + d)) * F.log1p(F.length(c)) / F.log(F.lit(401.0))
    return F.coalesce(score, F.lit(0.0))


def context(text: Column, start: Column, end: Column, width: int = 140) -> Column:
    """Window around the middle of a match (0-based), single blanks."""
    lo = F.greatest(F.lit(0), F.floor((start + end) / 2) - width // 2)
    return squeeze(F.substring(text, (lo + 1).cast("int"), F.lit(width)))


def finder_context(text: Column, start: Column, end: Column, width: int = 160) -> Column:
    """Window around the middle of a match (0-based), carried on to the ends of the words it cuts, single blanks."""
    lo = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - max(10, width // 2))
    hi = F.least(F.length(text), lo + width)
    before = F.regexp_extract(F.substring(text, F.lit(1), lo), r"[\p{L}\p{N}]*$", 0)
    after = F.regexp_extract(F.substring(text, hi + 1, F.lit(1 << 20)), r"^[\p{L}\p{N}]*", 0)
    return squeeze(F.concat(before, F.substring(text, lo + 1, hi - lo), after))


def kwic(text: Column, start: Column, end: Column, window: int) -> Column:
    lo = F.greatest(F.lit(0), start - window)
    return F.concat(F.substring(text, lo + 1, start - lo), F.lit("[["), F.substring(text, start + 1, end - start), F.lit("]]"), F.substring(text, end + 1, F.lit(window)))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/\\]+$", 0)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def mark_sentence(sentence: Column, citation: Column, sentiment: Column) -> Column:
    tag = F.when(citation & sentiment, " ⟦CITATION? + SENTIMENT⟧").when(citation, " ⟦CITATION?⟧").when(sentiment, " ⟦SENTIMENT⟧").otherwise("")
    return F.concat(sentence, tag)


def node_mass(x: Column) -> Column:
    return 1 + F.sqrt(F.greatest(F.lit(1), x))


# Words of a name's slug that don't name a family.
PARTICLES = ("von", "van", "de", "der", "den", "di", "da", "le", "la", "du", "del", "della", "zu")
GENERIC = ("werk", "werke", "chronik", "chroniken", "chronicon", "geschichte", "historie", "lexikon", "annales", "schrift", "schriften", "sammlung", "jahrbuch", "edition", "tigurinerchronik", "eidgenossische", "eidgenössische", "schweizerchronik", "band", "teil", "buch", "capell", "reformationsgeschichte")


def primary_token(slug: Column) -> Column:
    """The last part of a slug that is no particle, generic word, Roman numeral or number; else the first."""
    parts = F.filter(F.split(slug, "-"), lambda p: p != "")
    own = F.filter(parts, lambda p: ~p.isin(*PARTICLES, *GENERIC) & ~p.rlike("^[ivxlcdm]+$") & ~p.rlike(r"^\d+$"))
    return F.when(F.size(parts) == 0, slug).when(F.size(own) > 0, F.try_element_at(own, F.lit(-1))).otherwise(F.try_element_at(parts, F.lit(1)))


def split_authors(c: Column, marks: str = r"[;|]") -> Column:
    return F.filter(F.transform(F.split(c, marks), F.trim), lambda a: a != "")


def citation_line(*parts: Column) -> Column:
    """The parts that aren't empty, joined by commas."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def sanitized_filename(c: Column, longest: int = 120) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\r\n\t]+', "_"), r"\s+", " ")), F.lit(longest))


def strip_html(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]*>", " "))
