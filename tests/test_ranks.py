"""Places in a total order, and orders by a language's collation."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scriptorium.functions.ranks import ranked
from scriptorium.operators import binding


def test_places_are_those_of_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 2.0, rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, i int").repartition(7)
    for parts in (1, 5, 40):
        got = {r["i"]: r["place"] for r in ranked(df, [F.col("v"), F.col("i")], parts=parts).collect()}
        want = sorted(range(3000), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
        assert [got[i] for i in want] == list(range(1, 3001))
    assert ranked(df.limit(0), [F.col("v")]).count() == 0
    plan = ranked(df, [F.col("v"), F.col("i")])._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_german_readers_order(spark):
    names = ["Zürich", "zebra", "Ärzte", "Arzt", "arzt", "Öl", "ol", "ø", "oz", "Straße", "Strasse", "strasse", "strassf", "10", "9", "é", "e", "f", "", "ä", "az"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in ranked(rows, binding.locale_order(F.col("n"))).orderBy("place").collect()]
    at = {n: i for i, n in enumerate(got)}
    assert sorted(got) == sorted(names) and got[0] == "" and at["10"] < at["9"] < at["ä"] < at["arzt"]
    for less, more in (("arzt", "Arzt"), ("Arzt", "Ärzte"), ("Ärzte", "az"), ("e", "é"), ("é", "f"), ("ol", "Öl"), ("Öl", "oz"), ("ø", "oz"), ("strasse", "Strasse"), ("Strasse", "Straße"), ("Straße", "strassf"), ("zebra", "Zürich")):
        assert at[less] < at[more], (less, more)
