"""Candidates of many patterns: none that matches is missed, and spans are those of Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from scriptorium.functions import literals, patterns
from scriptorium.operators import binding, keywords, mentions

PIECES = ["chro?nik", r"\bvon\b", "(?:alt|neu)e", "[uü]ber", r"\d{4}", "(kern|bock)+", "x?y*", r"\s+", "straße", "(?i:Kirche)", "[a-z]", ".", "ſanct", "K", "i̇", r"(?=zug)", r"(a)(?:b|c|)\1", "(?<!n)icht", "[^a]"]


def test_no_matching_pattern_is_missed():
    rng = random.Random(2)
    words = ["chronik", "Chronk", "VON", "alte", "NEUE", "über", "UBER", "1444", "kern", "Bockkern", "xyy", " ", "STRASSE", "straße", "KIRCHE", "ſanct", "Sanct", "sanct", "K", "k", "İ", "ı", "zug", "abca", "nicht", "licht", "ẞ"]
    for _ in range(400):
        made = [p for p in ("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 3))) for _ in range(6)) if patterns.usable([p])]
        candidates = literals.Candidates(made)
        for _ in range(20):
            text = "".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 8)))
            matching = {i for i, p in enumerate(made) if re.search(p, text, re.IGNORECASE)}
            assert matching <= set(candidates.of(text)), (text, made)
    assert literals.needed("(?:alt|neu)e chronik") == {" chronik"} or "chronik" in str(literals.needed("(?:alt|neu)e chronik"))
    assert literals.needed(r"\d+") is None


def canon(n: int) -> list[str]:
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(3, 6)))
    shapes = [lambda a, b: rf"\b{a}\b", lambda a, b: rf"{a}\s+{b}", lambda a, b: rf"(?:{a}|{b})er?", lambda a, b: keywords.historic_name(f"{a} {b}"), lambda a, b: patterns.flexible_blanks(f"{a} {b}"), lambda a, b: patterns.surname_patterns(a)[2]]
    return [shapes[i % len(shapes)](word(), word()) for i in range(n - 2)] + [r"\d{4}", "("]


def test_spans_of_a_canon_of_250_patterns(spark):
    made, rng = canon(250), random.Random(1)
    names = [w for p in made for w in re.findall(r"[a-z]{3,}", p)]
    texts = [" ".join(rng.choice(names) if rng.random() < 0.3 else rng.choice(["und", "1444", "Der", "ſo"]) for _ in range(200)) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for first_only in (True, False):
        want = set()
        for d, text in enumerate(texts):
            seen = set()
            for i, p in enumerate(made):
                for m in re.finditer(p, text or "", re.IGNORECASE) if p != "(" else ():
                    if not first_only or m.span() not in seen:
                        seen.add(m.span())
                        want.add((d, i, *m.span(), m[0]))
        assert {tuple(r) for r in mentions.find_spans(docs, made, "doc_id", first_only=first_only).collect()} == want and want
    tried = [len(literals.Candidates(patterns.usable(made)).of(t)) for t in texts if t]
    assert sum(tried) < 250 * len(tried) * 0.7


def test_pages_go_to_python_once(spark):
    pages = spark.createDataFrame([(1, "Hans Kern und Karl Bock, Bock und Kern"), (2, "niemand"), (3, None), (4, "")], "page int, text string")
    targets = spark.createDataFrame([("k", ["kern"], [r"\bkern\b"], []), ("b", ["bock"], [r"\bbock\b", "("], None), ("e", [""], ["und"], []), ("n", None, ["Hans"], []), ("s", [None, "x"], ["Hans"], [])], "author_id string, surnames array<string>, patterns array<string>, negatives array<string>")
    found = binding.author_mentions(pages, targets, "page")
    assert sorted((r["page"], r["tgt"], r["start"]) for r in found.collect()) == [(1, "b", 19), (1, "b", 25), (1, "e", 10), (1, "e", 30), (1, "k", 5), (1, "k", 34)]
    assert "Join" not in found._jdf.queryExecution().toString()


def test_names_in_older_german_and_patterns_for_java(spark):
    assert re.search(keywords.historic_name("Hans  Fründ"), "sagt Hanſ\n Frvnd") is None and re.search(keywords.historic_name("Hans Vrund"), "so Hanſ\n Urvnd,")
    assert keywords.historic_literal("K.k") == r"K\.[kc]" and not re.search(keywords.historic_name("Hans"), "Hansen")
    given = ["a+", "(", r"(?P<x>a)", r"\p{L}+"]
    assert patterns.usable_in_java(spark, given) == ["a+", r"\p{L}+"]
    quoted = patterns.usable_in_java(spark, ["("], escape=True)
    assert spark.range(1).select(F.lit("a(b").rlike(quoted[0])).first()[0]
