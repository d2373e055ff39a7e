"""Decisions in order against plain loops."""

from __future__ import annotations

import difflib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import ordered, resolve
from scriptorium.plans import catalogue  # noqa: F401  registers its queries
from scriptorium.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def in_turn(rows):
    taken, out = set(), set()
    for k in sorted({(o, k) for k, _, o, _ in rows}):
        for _, e in sorted((p, e) for key, e, _, p in rows if key == k[1]):
            if e not in taken:
                taken.add(e)
                out.add((k[1], e))
                break
    return out


@pytest.mark.parametrize("few", [0, 15, 100_000])
def test_first_come_takes_in_turn(spark, few):
    rng = random.Random(few)
    for n, m in ((40, 12), (30, 60), (1, 1)):
        orders = {k: rng.randint(0, 30) for k in range(n)}
        rows = [(k, e, orders[k], rng.randint(0, 3)) for k in range(n) for e in rng.sample(range(m), min(m, rng.randint(1, 4)))]
        df = spark.createDataFrame(rows, "k int, e int, o int, p int")
        assert {tuple(r) for r in ordered.first_come(df, "k", "e", "o", "p", few=few).collect()} == in_turn(rows)
    empty = spark.createDataFrame([(None, 1, 1, 1), (1, None, 1, 1)], "k int, e int, o int, p int")
    assert ordered.first_come(empty, "k", "e", "o", "p", few=few).count() == 0


def test_rounds_of_first_come_are_few(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, e, k, p) for k in range(2000) for p, e in enumerate(rng.sample(range(3000), 3))]
    rounds = []
    written = ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, name: rounds.append(name) or written(df, name))
    got = ordered.first_come(spark.createDataFrame(rows, "k int, e int, o int, p int"), "k", "e", "o", "p", few=200)
    assert {tuple(r) for r in got.collect()} == in_turn(rows) and 1 < rounds.count("held") <= 12


def terms(n: int) -> list[str]:
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuwz") for _ in range(rng.randint(5, 11)))
    out = ["", "Frieden", "frieden", "Friedens", "Krieg", "", "FRIEDENS"]
    while len(out) < n:
        base = rng.choice(out) if rng.random() < 0.5 else word()
        out.append("".join(c for c in base if rng.random() > 0.06) + rng.choice(["", "", "e", "en"]))
    return out


def kept_in_turn(given, least=0.88):
    kept, m = [], difflib.SequenceMatcher(None)
    for t in given:
        c = t.casefold()
        for k in kept:
            if 2 * min(len(c), len(k)) >= least * (len(c) + len(k)):
                m.set_seqs(c, k)
                if m.quick_ratio() >= least and m.ratio() >= least:
                    break
        else:
            kept.append(c)
    return kept


@pytest.mark.parametrize(("n", "few"), [(300, 0), (300, 60), (5000, 2000)])
def test_leaders_are_those_of_a_list(spark, n, few):
    given = terms(n)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)] + [(n, None)], "i long, term string").repartition(4)
    got = [r["term"].casefold() for r in ordered.leaders(rows, "i", "term", few=few).orderBy("i").collect()]
    assert got == kept_in_turn(given)
    if n == 300:
        assert [t.casefold() for t in resolve.deduplicated_terms(given)] == got
    assert ordered.leaders(rows.limit(0), "i", "term").count() == 0


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
def test_registered_queries_equal_plain_loops(spark):
    rows = [(r["l_suppkey"], r["l_partkey"], r["l_suppkey"], -r["q"]) for r in spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).collect()]
    assert {tuple(r) for r in QUERIES["first_come_assignment"](spark, DATA).collect()} == in_turn(rows)
    names = {}
    for r in spark.read.parquet(f"{DATA}/part.parquet").orderBy("p_partkey").collect():
        names.setdefault(f"{r['p_name']} {r['p_brand']}", r["p_partkey"])
    got = QUERIES["near_duplicate_terms"](spark, DATA).orderBy("first_id").collect()
    assert [r["term"].casefold() for r in got] == kept_in_turn(names) and len(got) < len(names)
