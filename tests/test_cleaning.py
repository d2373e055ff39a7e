"""The cleaners of editions and early prints against plain Python, on made-up pages and on the registered queries."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from scriptorium.operators import cleaning as C
from scriptorium.plans import mentions  # noqa: F401  registers its queries
from scriptorium.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
LIGATURES = {"ſ": "s", "ﬅ": "st", "ﬁ": "fi", "ﬂ": "fl"}


def plain(p, s, new=""):
    """A pattern of Java's; the texts here have no white space or digits beyond ASCII."""
    return regex.sub(p.replace(r"\z", r"\Z"), new, s)


def held(p, s):
    return regex.search(p, s) is not None


def wide(patterns, s, flags=regex.IGNORECASE):
    return any(regex.search(p, s, flags=flags) for p in patterns)


def lines(s, drop):
    return "\n".join(x for x in s.split("\n") if not drop(x))


def paragraphs(s):
    own = [plain(r"[ \t]*\n[ \t]*", plain(r"^\s+|\s+$", p).strip(" "), " ") for p in regex.split(r"\n{2,}", s)]
    return [p for p in own if p]


def unhyphenated(s):
    return regex.sub(C.CUT_WORD, "", s).replace("­", "")


def tidy(s):
    for p, new in C.TIDY:
        s = plain(p, s, new.replace("$1", r"\1"))
    return plain(r"^\s+|\s+$", s)


def chronicle(text):
    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    s = plain(C.LEADING_NUMBER, text)
    s = lines(s, lambda x: any(held(p, x.strip(" ")) for p in C.FURNITURE) or wide(C.EDITORIAL, x))
    for p in (*C.BRACKETS, *[rf"\([^)]*{a}[^)]*\)" for a in C.APPARATUS], *C.FOOTNOTES):
        s = regex.sub(p, "", s)
    return paragraphs(unhyphenated(s))


def editorial(p):
    return wide(C.EDITORIAL, p) or held(r"[\[\]]", p) or held(r"\([^)]*\d{2,4}[^)]*\)", p) or p.count(";") >= 3


def score(p):
    return 2 * wide([C.OPENING], p) + 2 * held(C.YEAR, p) + wide(C.ARCHAIC, p) - (len(regex.findall(r"[()]", p)) > 2)


def edition(text):
    return tidy("\n\n".join(p for p in chronicle(text) if not editorial(p) and score(p) >= 2))


def early_print(text):
    for a, b in (LIGATURES | {"­": ""}).items():
        text = text.replace(a, b)
    s = plain(C.PAGE_BREAK, plain(C.REGISTER, text))
    s = lines(s, lambda x: any(held("(?i)" + p, x) for p in C.STAMPS) or any(held(p, x.strip(" ")) for p in (*C.FURNITURE, *C.LETTER_FURNITURE)))
    return tidy(plain(C.OLD_AND, "\n\n".join(paragraphs(unhyphenated(plain(C.LEADING_NUMBER, s)))), "und"))


PIECES = ("Anno 1444 do zoch der hertzog uff die statt", "Item der bischof", "vnd vnnd Vnd", "12", " XIV ", "—--", "BASLER CHRONIKEN", "A IV (b)", "<123456789>", "Bayerische Staatsbibliothek 3", "Oecon. 12", "[Randnote]", "«alt»", "(Vgl. S. 12)", "(siehe Anm. 3)",
          "(ein Wort)", "((a Urk) b)", "(offen", "1377", "wort12,", "3)", "(4)", "⁵", "^7", "ge-", "schichte", "ſo gieng", "ﬁne", "Vorrede", "--- 3 / 9 ---", "Register", "a;b;c;d", "von Bd. 3", "  ", "\t", ";", ",", " .", "( x )", "übergräf", "ritter­schaft", "9 Zeile")


def made(n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(PIECES) + rng.choice((" ", "\n", "\n", "\n\n", "\n \n", "")) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_cleaners_on_made_up_pages(spark):
    texts = made(600)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", C.clean_edition(F.col("text")).alias("e"), C.clean_print(F.col("text")).alias("p"), C.chronicle_paragraphs(F.col("text")).alias("c")).collect()
    for r in got:
        t = texts[r["i"]]
        assert (r["c"], r["e"], r["p"]) == (chronicle(t), edition(t), early_print(t)), t
    assert sum(r["e"] != "" for r in got) > 100


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
def test_registered_cleaning_queries_equal_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["edition"], r["early_print"]) for r in QUERIES["clean_documents"](spark, DATA).collect()}
    assert got == {i: (None, None) if t is None else (edition(t), early_print(t)) for i, t in texts.items()}
    kept = {r["doc_id"]: (r["total"], r["editorial"], r["kept"], r["low"]) for r in QUERIES["paragraphs_kept"](spark, DATA).collect()}
    want = {}
    for i, t in texts.items():
        own = [(editorial(p), score(p) >= 2) for p in chronicle(t or "")]
        if own:
            want[i] = (len(own), sum(e for e, _ in own), sum(not e and s for e, s in own), sum(not e and not s for e, s in own))
    assert kept == want
