"""Every registered query against its SQL; those without SQL run and have stable columns."""

from __future__ import annotations

from pathlib import Path

import pytest

from scriptorium.plans import binding, catalogue, library, mentions, networks  # noqa: F401
from scriptorium.plans.registry import QUERIES, SQL

from tests import oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, DATA), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert df.columns and rows and len({tuple(r) for r in rows}) == len(rows)


def test_greedy_assignment_takes_pairs_one_by_one(spark, con):
    pairs = con.execute("SELECT sum(l_quantity) AS score, l_suppkey, l_partkey FROM lineitem GROUP BY ALL ORDER BY score DESC, l_suppkey, l_partkey").fetchall()
    want, suppliers, parts = set(), set(), set()
    for score, s, p in pairs:
        if s not in suppliers and p not in parts:
            want.add((s, p, float(score)))
            suppliers.add(s)
            parts.add(p)
    taken = QUERIES["greedy_assignment"](spark, DATA).collect()
    assert {(r["l_suppkey"], r["l_partkey"], float(r["score"])) for r in taken} == want and len(taken) == len(want)


def test_edge_thinning_takes_edges_one_by_one(spark):
    edges = sorted(((r["weighted"], r["src"], r["tgt"]) for r in QUERIES["author_edges"](spark, DATA).collect()), key=lambda e: (-e[0], e[1], e[2]))
    want, degree, skipped = set(), {}, 0
    for weight, u, v in edges:
        if len(want) == 300:
            break
        if degree.get(u, 0) >= 6 and degree.get(v, 0) >= 6:
            skipped += 1
            continue
        want.add((u, v, weight))
        for end in (u, v):
            degree[end] = degree.get(end, 0) + 1
    assert {tuple(r) for r in QUERIES["edge_thinning_greedy"](spark, DATA).select("u", "v", "weight").collect()} == want
    assert skipped > 0
