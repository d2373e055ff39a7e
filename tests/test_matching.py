"""Set joins, top-k similarity and fuzzy matches against plain Python over all pairs."""

from __future__ import annotations

import difflib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import fuzzy, resolve, rowblocks, setjoin, similarity
from scriptorium.plans import registry as catalogue
from scriptorium.plans import catalogue as _catalogue  # noqa: F401  registers its queries


def titles(seed: int, n: int) -> list[tuple[int, str]]:
    """Titles of a few words, all but some with a word that all share; some repeat others with small changes."""
    rng = random.Random(seed)
    pool = [f"w{i:03d}x" for i in range(120)]
    out = []
    for i in range(n):
        own = rng.sample(pool, rng.randint(1, 9))
        if i % 3 == 0 and out:
            own = rng.choice(out)[1].split()[: rng.randint(2, 9)] + own[:1]
        out.append((i, " ".join(own + ["allgemein"] * (i % 10 != 0))))
    return out


def all_pairs(left, right):
    sets = lambda rows: [(i, {w for w in t.split() if len(w) >= 3}) for i, t in rows if t]
    return [(i, e, len(a & b), len(a), len(b)) for i, a in sets(left) for e, b in sets(right) if a & b]


@pytest.mark.parametrize("bars", [(), (0.5, 0.2), (0.9, 0.3)])
def test_best_pairs_are_those_of_all_pairs(spark, bars):
    left, right = titles(1, 120) + [(500, None), (501, ""), (502, "unknown words"), (3, "another text of id three w001x")], titles(2, 90) + [(900, None)]
    a, b = spark.createDataFrame(left, "k int, name string"), spark.createDataFrame(right, "e int, title string")
    pairs = all_pairs(left, right)
    for jaccard, measure in ((True, lambda s, n, m: round(s / (n + m - s), 4)), (False, lambda s, n, m: s)):
        best = {}
        for k, e, s, n, m in pairs:
            best[k] = min(best.get(k, (0, 0)), (-measure(s, n, m), e))
        found = setjoin.best_pairs(a, "k", "name", b, "e", "title", jaccard=jaccard, bars=bars)
        assert {tuple(r) for r in found.select("k", "entity", "shared", "n_left", "n_right").collect()} <= set(pairs)
        got = resolve.jaccard_best(found, "k") if jaccard else resolve.best_overlap(found, "k")
        assert {r[0]: (-r[2], r[1]) for r in got.collect()} == best
        if not jaccard:
            top = Counter((k, s) for k, _, s, _, _ in pairs)
            alone = {k for k, (s, _) in best.items() if top[k, -s] == 1}
            assert {r["k"] for r in resolve.unique_winner(found, "k").collect()} == alone
    assert setjoin.best_pairs(a.limit(0), "k", "name", b, "e", "title", bars=bars).count() == 0


@pytest.mark.parametrize("short, counted", [(64, 0), (3, 0), (64, 1 << 34)])
def test_pairs_of_short_sets_are_counted_where_they_meet(spark, monkeypatch, short, counted):
    """All rounds, or blocks after the first, with and without sets too long to go along: the same best, and no table of candidates but of long sets."""
    monkeypatch.setattr(setjoin, "SHORT", short)
    monkeypatch.setattr(setjoin, "COUNTED", counted)
    names, write = [], setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: names.append(name) or write(df, name))
    left, right = titles(5, 80), titles(6, 60)
    a, b = spark.createDataFrame(left, "k int, name string"), spark.createDataFrame(right, "e int, title string")
    best = {}
    for k, e, s, n, m in all_pairs(left, right):
        best[k] = min(best.get(k, (0, 0)), (-round(s / (n + m - s), 4), e))
    got = resolve.jaccard_best(setjoin.best_pairs(a, "k", "name", b, "e", "title"), "k")
    assert {r[0]: (-r[2], r[1]) for r in got.collect()} == best
    assert ("candidates" in names) == (short == 3)
    assert names.count("near") == (1 if counted else 2)


@pytest.mark.parametrize("jaccard", [True, False])
def test_only_the_best_leave_a_task(spark, monkeypatch, jaccard):
    """Blocks and parts of any size give the same; of a thousand pairs with a common word few leave a task."""
    left, right = titles(3, 100) + [(100 + i, "allgemein nirgends") for i in range(50)] + [(None, "w001x"), (200, None), (201, "unknown")], titles(4, 80) + [(None, "w001x w002x"), (900, None)]
    a, b = spark.createDataFrame(left, "k int, name string"), spark.createDataFrame(right, "e int, title string")
    best = {}
    place = lambda e: (e is not None, e or 0)
    for k, e, s, n, m in all_pairs(left, right):
        best.setdefault(k, []).append((-round(s / (n + m - s), 4) if jaccard else -s, place(e), e))
    for words, sets, part in ((1 << 21, 1 << 14, 1 << 21), (60, 7, 90)):
        for name, n in (("WORDS", words), ("SETS", sets), ("PART", part)):
            monkeypatch.setattr(setjoin, name, n)
        found = setjoin.best_pairs(a, "k", "name", b, "e", "title", jaccard=jaccard, bars=()).cache()
        got = resolve.jaccard_best(found, "k") if jaccard else resolve.best_overlap(found, "k")
        assert {r[0]: (-r[2], r[1]) for r in got.collect()} == {k: (min(v)[0], min(v)[2]) for k, v in best.items()}
        if not jaccard:
            alone = {k for k, v in best.items() if [s for s, *_ in v].count(min(v)[0]) == 1}
            assert {r["k"] for r in resolve.unique_winner(found, "k").collect()} == alone
        if sets > len(right):
            assert set(map(tuple, found.select("k", "entity", "shared", "n_left", "n_right").collect())) <= set(all_pairs(left, right))
            assert found.count() <= 3 * len(left) < len(all_pairs(left, right)) / 8


def test_a_word_that_most_hold_makes_no_candidates(spark):
    left, right = titles(1, 300), titles(2, 300)
    words = lambda rows: spark.createDataFrame([(i, w) for i, t in rows for w in set(t.split())], "id int, word string").withColumn("n", F.count("*").over(setjoin.Window.partitionBy("id")))
    df = words(right).groupBy("word").agg(F.count("*").alias("df"))
    x, y = setjoin._placed(words(left), "id", df).withColumnRenamed("id", "k"), setjoin._placed(words(right), "id", df).withColumnRenamed("id", "entity")
    by_words = len(all_pairs(left, right))
    near = {(k, e) for k, e, s, n, m in all_pairs(left, right) if s / (n + m - s) >= 0.5}
    got = {(r["k"], r["entity"]) for r in setjoin.candidates(x, y, "k", 0.5, True).collect()}
    assert near <= got and len(got) < by_words / 8


def plain_neighbours(m, n):
    rows = {}
    for r, c, w in m:
        rows.setdefault(r, {})[c] = w
    unit = {r: {c: w / sum(x * x for x in v.values()) ** 0.5 for c, w in v.items()} for r, v in rows.items() if any(v.values())}
    out = {}
    for a, x in unit.items():
        near = [(-round(sum(w * y.get(c, 0) for c, w in x.items()), 6), b) for b, y in unit.items() if b != a and any(w and y.get(c) for c, w in x.items())]
        out[a] = [(b, -s) for s, b in sorted(near)[:n]]
    return {a: v for a, v in out.items() if v}


@pytest.mark.parametrize("cell", [7, 4096])
def test_top_neighbours_are_those_of_all_pairs(spark, cell):
    rng = random.Random(3)
    m = [(r, f"c{c}", float(rng.randint(1, 9))) for r in range(150) for c in rng.sample(range(60), rng.randint(1, 8))]
    m += [(r, "hot", 0.5) for r in range(150)] + [(900, "own", 1.0), (901, "hot", 0.0), (902, "hot", 2.0)]
    got = {}
    for r in similarity.top_neighbours(spark.createDataFrame(m, "r int, c string, w double"), 4, cell=cell).orderBy("a", "rank").collect():
        got.setdefault(r["a"], []).append((r["b"], r["similarity"]))
    want = plain_neighbours(m, 4)
    assert got.keys() == want.keys()
    for a, near in want.items():
        assert [b for b, _ in got[a]] == [b for b, _ in near] or [s for _, s in got[a]] == pytest.approx([s for _, s in near], abs=1.1e-6)
    assert similarity.top_neighbours(spark.createDataFrame([], "r int, c string, w double"), 4).count() == 0


def test_a_column_that_all_hold_is_left_out_of_the_search(spark, monkeypatch):
    m = [(r, f"c{r // 5}", 3.0 + r % 5) for r in range(200)] + [(r, "hot", 0.3) for r in range(200)]
    seen = []
    met = similarity._met
    monkeypatch.setattr(similarity, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    assert similarity.top_neighbours(spark.createDataFrame(m, "r int, c string, w double"), 3).count() == 600
    assert seen[-1].count() <= 200 * 4


def blocks(n: int, rows: int, columns: int, seed: int = 4) -> list[tuple[int, str, float]]:
    """Entries of n groups of rows that share columns only with one another, each column with 8 of a group's rows, all of like weight."""
    rng = random.Random(seed)
    return [(g * rows + r, f"{g}-{c}", float(rng.randint(1, 3))) for g in range(n) for c in range(columns) for r in rng.sample(range(rows), 8)]


def test_sums_by_pairs_shrink_before_the_shuffle(spark, monkeypatch):
    m = blocks(12, 20, 60)
    df = spark.createDataFrame(m, "r int, c string, w double").withColumn("df", F.lit(8))
    monkeypatch.setattr(similarity, "TASK", 4096)
    each = similarity._products(df, df, 512).where("x.r < y.r").select("x.r", F.col("y.r").alias("b"), F.spark_partition_id().alias("task"))
    assert each.select("task").distinct().count() >= 8 and each.count() == 12 * 60 * 28
    assert each.distinct().count() < 2.5 * each.select("r", "b").distinct().count()


@pytest.mark.parametrize("cell, row", [(512, 4096), (5, 7)])
def test_pairs_are_those_of_all_rows(spark, monkeypatch, cell, row):
    monkeypatch.setattr(similarity, "ROW", row)
    m = blocks(3, 12, 10) + [(r, "hot", 2.0) for r in range(36)]
    rows = {}
    for r, c, w in m:
        rows.setdefault(r, {})[c] = w
    size = {r: sum(w * w for w in v.values()) ** 0.5 for r, v in rows.items()}
    want = {(a, b): (sum(w * y[c] for c, w in x.items() if c in y) / (size[a] * size[b]), len(x.keys() & y.keys())) for a, x in rows.items() for b, y in rows.items() if a < b and x.keys() & y.keys()}
    got = {(r["a"], r["b"]): (r["similarity"], r["shared"]) for r in similarity.cosine_pairs(spark.createDataFrame(m, "r int, c string, w double"), cell=cell).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(s, abs=6e-7), n) for k, (s, n) in want.items())


@pytest.mark.parametrize("entries, long, at_once", [(10**6, 10**6, 1 << 20), (40, 10**6, 50), (40, 33, 50)])
def test_pairs_of_blocks_are_those_of_all_rows_and_none_is_shuffled(spark, monkeypatch, entries, long, at_once):
    """Blocks of any size, rows too long for one, columns that are null or all rows hold: the same pairs, of which a plan without long rows exchanges none."""
    for name, value in (("ENTRIES", entries), ("FEW", entries), ("LONG", long)):
        monkeypatch.setattr(rowblocks, name, value)
    rng = random.Random(8)
    m = blocks(3, 12, 10) + [(r, "hot", 2.0) for r in range(36)] + [(r, None, 3.0) for r in range(20, 50)] + [(60, f"{g}-{c}", 1.0 + c) for g in range(3) for c in range(10)] + [(60, "hot", 1.0)] * 1 + [(60, f"own{c}", 1.0) for c in range(4)]
    rng.shuffle(m)
    rows = {}
    for r, c, w in m:
        rows.setdefault(r, {})[c] = w
    size = {r: sum(w * w for w in v.values()) ** 0.5 for r, v in rows.items()}
    met = {(a, b): [c for c in x if c is not None and c in y] for a, x in rows.items() for b, y in rows.items() if a < b}
    want = {(a, b): (sum(rows[a][c] * rows[b][c] for c in cs) / (size[a] * size[b]), len(cs)) for (a, b), cs in met.items() if cs}
    df = spark.createDataFrame([(f"{r:03d}", c, w) for r, c, w in m], "r string, c string, w double")
    out = similarity.cosine_pairs(df, cell=at_once)
    assert (long == 33) == ("Exchange" in out._jdf.queryExecution().executedPlan().toString())
    got = {(int(r["a"]), int(r["b"])): (r["similarity"], r["shared"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(s, abs=6e-7), n) for k, (s, n) in want.items())
    few = [(r, c, w) for r, c, w in m if c not in (None, "hot")]
    near = {}
    for r in similarity.top_neighbours(spark.createDataFrame(few, "r int, c string, w double"), 3).orderBy("a", "rank").collect():
        near.setdefault(r["a"], []).append((r["b"], r["similarity"]))
    assert near == {a: [(b, pytest.approx(s, abs=1e-9)) for b, s in v] for a, v in plain_neighbours(few, 3).items()}


def test_entries_are_not_shuffled_by_row_for_their_sums(spark, monkeypatch):
    m = spark.createDataFrame(blocks(2, 10, 6), "r int, c string, w double")
    plan = similarity.tf_idf(m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    want = sorted(map(tuple, similarity.tf_idf(m).collect()))
    monkeypatch.setattr(similarity, "BROADCAST", 3)
    assert sorted(map(tuple, similarity.tf_idf(m).collect())) == want


def test_the_best_of_a_block_alone_leave_it(spark, monkeypatch):
    monkeypatch.setattr(rowblocks, "FEW", 10**6)
    m = spark.createDataFrame(blocks(4, 20, 60), "r int, c string, w double")
    assert rowblocks.best(m, 3).count() == 80 * 3


def test_places_are_those_of_spark(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(2000)] + [rng.randint(0, 10**7) / 10**7 for _ in range(2000)] + [0.0078125, 1 / 128 + 1e-17, 0.0, 1.0, 0.9999995, 1.0000000000000002, 5e-7]
    rounded = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert rowblocks.millionths(np.array(values)).tolist() == [round(v * 1e6) for v in rounded]


def test_rare_columns_leave_no_pairs_to_complete(spark, monkeypatch):
    completed = []
    dots = similarity._dots
    monkeypatch.setattr(similarity, "_dots", lambda pairs, *a: completed.append(pairs.count()) or dots(pairs, *a))
    m = blocks(4, 20, 60)
    got = {}
    for r in similarity.top_neighbours(spark.createDataFrame(m, "r int, c string, w double"), 3).collect():
        got.setdefault(r["a"], {})[r["rank"]] = r["similarity"]
    assert {a: [s for _, s in sorted(v.items())] for a, v in got.items()} == {a: pytest.approx([s for _, s in v], abs=1.1e-6) for a, v in plain_neighbours(m, 3).items()}
    assert sum(completed) <= 3 * 80


def test_equal_keys_go_before_words(spark):
    left = spark.createDataFrame([(1, "Die Alte Chronica!"), (2, "alte chronica die"), (3, "ganz anders alte"), (4, "x y"), (5, None)], "k int, name string")
    right = spark.createDataFrame([(10, "alte die chronica"), (11, "die alte  chronica"), (12, "X-Y")], "e int, title string")
    got = {r["k"]: (r["entity"], r["step"], r["confidence"]) for r in resolve.key_or_words(left, "k", "name", right, "e", "title").collect()}
    assert got == {1: (11, 0, 1.0), 2: (10, 1, 1.0), 3: (10, 1, 0.2), 4: (12, 0, 1.0)}
    assert T.STOPWORDS


def test_near_titles_are_found_by_few_words(spark, monkeypatch):
    rng = random.Random(6)
    right = [(i, " ".join(rng.sample([f"w{j:02d}x" for j in range(60)], 6))) for i in range(200)]
    a = spark.createDataFrame([(i, "neue ausgabe " + t) for i, t in right], "id int, name string")
    b = spark.createDataFrame(right, "e int, title string")
    met = setjoin.candidates
    seen = []
    monkeypatch.setattr(setjoin, "candidates", lambda *args: seen.append(met(*args).count()) or met(*args))
    rows = sorted(map(tuple, resolve.key_or_words(a, "id", "name", b, "e", "title").collect()))
    few, seen = sum(seen), []
    assert rows == sorted(map(tuple, resolve.key_or_words(a, "id", "name", b, "e", "title", bars=setjoin.BARS).collect()))
    assert all(r[1:] == (r[0], 1, 0.75) for r in rows) and len(rows) == 200 and 2 * few < sum(seen)


def every_pair(left, right, least, top):
    """Up to top (entity, score) for each key by difflib's ratio of all pairs."""
    plain = lambda t: " ".join(sorted(re.findall(r"[a-z0-9]+", (t or "").lower())))
    a, b = [(k, plain(n)) for k, n in left], [(e, plain(n)) for e, n in right]
    out = {}
    for k, x in a:
        scored = [(-round(100 * difflib.SequenceMatcher(None, x, y).ratio(), 4), e) for e, y in b if x and y and min(len(x), len(y)) * 2 >= least / 100 * (len(x) + len(y))]
        out |= {(k, i + 1): (e, -s) for i, (s, e) in enumerate(sorted(x for x in scored if x[0] <= -least)[:top])}
    return out


def test_fuzzy_matches_are_those_of_all_pairs(spark):
    names = ["Meister Eckhart", "Eckart Maister", "Heinrich Seuse", "Supplier#000000001", "", None, "Tauler", "der der mann", "x"]
    texts = ["Eckharts Meisterr", "Meister Eckhart", "Hainrich Suso", "Heinrich Seuse", "Customer#000000001", "Customer#000000011", "Taulers", "", None, "Ekkehart Meister", "xyz", "der mann", "mann der der", "Meister Eckhart"]
    want = every_pair(list(enumerate(names)), list(enumerate(texts)), 60, 3)
    left, right = spark.createDataFrame(list(enumerate(names)), "k long, name string"), spark.createDataFrame(list(enumerate(texts)), "e long, title string")
    got = {(r["k"], r["nth"]): (r["entity"], r["score"]) for r in fuzzy.best_matches(left, "k", "name", right, "e", "title", top=3).collect()}
    assert got == want and got[7, 1] == (12, 100.0) and got[7, 2][1] < 100
    assert fuzzy.best_matches(left.limit(0), "k", "name", right, "e", "title").count() == 0


def test_fuzzy_matches_of_a_thousand_by_a_thousand(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprstz") for _ in range(rng.randint(3, 8)))
    right = [(e, " ".join(word() for _ in range(rng.randint(1, 4)))) for e in range(1000)]
    changed = lambda t: "".join(c if rng.random() > 0.08 else rng.choice("aeiou ") for c in t)
    left = [(k, changed(right[k][1]) if k % 4 else " ".join(word() for _ in range(3))) for k in range(1000)]
    a, b = spark.createDataFrame(left, "k long, name string"), spark.createDataFrame(right, "e long, title string")
    got = {(r["k"], r["nth"]): (r["entity"], r["score"]) for r in fuzzy.best_matches(a, "k", "name", b, "e", "title", top=2).collect()}
    assert got == every_pair(left, right, 60, 2)
    x, y = a.select("k", fuzzy.sorted_words(a["name"]).alias("x")).withColumnRenamed("k", "a"), b.select("e", fuzzy.sorted_words(b["title"]).alias("y")).withColumnRenamed("e", "b")
    assert fuzzy.candidates(x, y, fuzzy._bars(x, y, 60, 2), 60).count() < 1_000_000 / 8


def test_names_of_one_pattern_are_not_scored_by_all_pairs(spark, monkeypatch):
    """Few rows are written for each name, whatever the titles; blocks, copies, ids with several texts and long names make no difference."""
    long = "ein sehr langer name " * 4
    left = [(k, f"Supplier#{k % 50:09d}") for k in range(60)] + [(3, "Supplier#000000777"), (90, long + "alt"), (91, None)]
    right = [(e, f"Customer#{e % 600:09d}") for e in range(2400)] + [(5, "Customer#000000041"), (None, "Customer#000000007"), (9000, long + "neu"), (9001, "x" * 300)]
    rows = []
    kept = fuzzy.written
    monkeypatch.setattr(fuzzy, "written", lambda df, name: rows.append(kept(df, name)) or rows[-1])
    monkeypatch.setattr(fuzzy, "TITLES", 150)
    a, b = spark.createDataFrame(left, "k long, name string"), spark.createDataFrame(right, "e long, title string")
    got = {(r["k"], r["nth"]): (r["entity"], r["score"]) for r in fuzzy.best_matches(a, "k", "name", b, "e", "title").collect()}
    of = {}
    for (k, _), (e, s) in every_pair(list(enumerate(n for _, n in left)), list(enumerate(t for _, t in right)), 60, 3000).items():
        near = of.setdefault(left[k][0], {})
        near[right[e][0]] = max(s, near.get(right[e][0], 0))
    place = lambda e: (e is not None, e or 0)
    want = {(k, i + 1): r for k, near in of.items() for i, r in enumerate(sorted(near.items(), key=lambda r: (-r[1], place(r[0])))[:5])}
    assert got == want
    assert max(df.count() for df in rows if {"x", "y"} <= set(df.columns)) <= 3_000


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_beginnings_are_left_only_below_the_bar(monkeypatch, step):
    monkeypatch.setattr(fuzzy, "STEP", step)
    rng = random.Random(8)
    some = lambda n, most: sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(1, most))) for _ in range(n)})
    names, titles = [*some(30, 12), "a" * fuzzy.LETTERS], some(200, 20)

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last, row = row, [0]
            for j, d in enumerate(y):
                row.append(last[j] + 1 if c == d else max(row[j], last[j + 1]))
        return row[-1]

    bars = fuzzy.np.array([rng.choice([40.0, 60.0, 80.0]) for _ in names])
    who, title, n = fuzzy._reaching(names, bars, *fuzzy._levels(titles))
    got = {(i, t): c for i, t, c in zip(who.tolist(), title.tolist(), n.tolist(), strict=True)}
    want = {(i, t): common(x, y) for i, x in enumerate(names) for t, y in enumerate(titles)}
    assert got == {k: c for k, c in want.items() if c and 200 * c >= bars[k[0]] * (len(names[k[0]]) + len(titles[k[1]]))}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_registered_fuzzy_query_equals_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    rows = lambda t, k, n: [(r[k], r[n]) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    got = {(r["s_suppkey"], r["nth"]): (r["entity"], r["score"]) for r in catalogue.QUERIES["fuzzy_catalogue_match"](spark, d).collect()}
    assert got == every_pair(rows("supplier", "s_suppkey", "s_name"), rows("customer", "c_custkey", "c_name"), 60, 5) and got


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["jaccard_best_match", "resolve_waterfall", "unique_token_winner"])
def test_documents_meet_items_in_one_round(spark, monkeypatch, name):
    rows = []
    kept = setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: rows.append(name) or kept(df, name))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 100
    assert rows == ["left_sets", "right_sets"]


@pytest.mark.parametrize("sets, broadcast", [(1 << 14, "10m"), (7, "-1")])
def test_equal_keys_or_most_words_are_those_of_all_pairs(spark, monkeypatch, sets, broadcast):
    """Keys keep every word, as in the SQL of resolve_waterfall; blocks of any size and plain joins give the same."""
    monkeypatch.setattr(setjoin, "SETS", sets)
    right = titles(4, 80) + [(200, "Die Alte Chronik"), (201, "alte die chronik"), (202, "die alte"), (203, "X-Y"), (204, None), (205, "die, alte chronik!"), (206, ""), (207, "Äpfel ﬁnden")]
    left = titles(3, 60) + [(300 + e, f"{t} !") for e, t in titles(4, 9)] + [
        (400, "DIE ALTE CHRONIK"), (401, "die alte"), (402, "alte chronik die"), (403, "chronik die alte"), (404, "x y"), (405, "y x"), (406, None), (407, " !"),
        (408, "die die alte chronik"), (409, "apfel ﬁnden"), (409, "w001x w002x"), (410, "w003x"), (410, "w003x"), (None, "die alte"), (None, "w004x allgemein"),
    ]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower().replace("ä", "a"))
    want, place = {}, lambda k: (k is not None, k or 0)
    for k, a in left:
        for e, b in right:
            if words(a) and words(a) == words(b):
                want.setdefault(k, []).append((0, -1.0, e))
            n = len({w for w in words(a) if len(w) > 2} & {w for w in words(b) if len(w) > 2})
            if n:
                want.setdefault(k, []).append((1, -float(n), e))
    monkeypatch.setattr(setjoin, "PART", 90)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = resolve.key_or_overlap(spark.createDataFrame(left, "k int, name string"), "k", "name", spark.createDataFrame(right, "e int, title string"), "e", "title").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(((r["k"], r["step"], -r["score"], r["entity"]) for r in got), key=lambda r: place(r[0])) == sorted(((k, *min(v)) for k, v in want.items()), key=lambda r: place(r[0]))
    assert {k: min(v)[0] for k, v in want.items() if k and k >= 400} == {400: 0, 401: 0, 402: 1, 403: 1, 404: 0, 408: 1, 409: 0, 410: 1}


@pytest.mark.parametrize("name", ["jaccard_best_match", "resolve_waterfall", "unique_token_winner"])
@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_texts_are_split_once_and_stay_where_they_are(spark, monkeypatch, name):
    """The sets of documents are written without a shuffle, from one splitting of each text (a second one only where a key has to be compared), and meet the items in their own tasks."""
    plans = {}
    kept = setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or kept(df, name))
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    if name == "resolve_waterfall":
        left = plans["left_sets"].split("Aggregate")[0]  # documents and items; the key
        assert left.count("translate(") == 3 and left.count("CASE WHEN met") == 1
    else:
        assert plans["left_sets"].count("translate(") == 1 and "Aggregate" not in plans["left_sets"]
