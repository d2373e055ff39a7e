"""Versioned tables: write-back, repeated runs, interrupted and meeting writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import citations
from scriptorium.sinks import versions
from scriptorium.sources import files


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/works"


WORKS = "id long, author string, title_key string, year int, title string"


def works(spark, *rows):
    return spark.createDataFrame(list(rows), WORKS)


def test_changes_are_written_back_and_old_versions_stay(spark, folder):
    assert versions.version(folder) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder)
    keys = ("author", "title_key", "year")
    versions.upsert(spark, folder, works(spark, (1, "a", "t", 1, "T"), (2, "b", "u", 2, "U")), keys, ("title",), run="r1")
    versions.upsert(spark, folder, works(spark, (3, "a", "t", 1, None), (4, "c", "v", 3, "V")), keys, ("title",), run="r2")
    after = sorted(map(tuple, versions.read(spark, folder).select("author", "title").collect()))
    assert after == [("a", "T"), ("b", "U"), ("c", "V")]
    same = versions.upsert(spark, folder, works(spark, (9, "z", "z", 9, "Z")), keys, (), run="r1")
    assert same.number == 2 and same.runs == ("r1", "r2") and versions.read(spark, folder).count() == 3
    versions.insert_or_ignore(spark, folder, works(spark, (5, "a", "t", 1, "other"), (6, "d", "w", 4, "W"), (7, "d", "w", 4, "W2")), "author", "title_key")
    assert versions.read(spark, folder).count() == 4
    versions.rebuilt(spark, folder, works(spark).limit(0))
    assert versions.read(spark, folder).count() == 0 and versions.read(spark, folder).columns == WORKS.replace(",", "").split()[::2]
    assert [versions.read(spark, folder, n).count() for n in versions.versions(folder)] == [2, 3, 4, 0]


def test_runs_shared_by_two_tables_may_be_repeated(spark, tmp_path):
    edges, hits = f"file://{tmp_path}/edges", f"file://{tmp_path}/hits"
    rows = spark.createDataFrame([(1, 2), (2, 3)], "u int, v int")
    versions.added(spark, edges, rows, "run-1")
    for _ in range(2):  # the first writer broke off between the tables
        versions.added(spark, edges, rows, "run-1")
        versions.added(spark, hits, rows.limit(1), "run-1")
    versions.added(spark, edges, rows.limit(1), "run-2")
    assert {tuple(r) for r in versions.read(spark, edges).groupBy("run_id").count().collect()} == {("run-1", 2), ("run-2", 1)}
    assert versions.read(spark, hits).count() == 1


def test_a_writer_that_breaks_off_leaves_the_old_version(spark, folder):
    versions.rebuilt(spark, folder, works(spark, (1, "a", "t", 1, "T")))
    broken = works(spark, (2, "b", "u", 2, "U")).withColumn("year", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        versions.rebuilt(spark, folder, broken)
    assert versions.versions(folder) == [1] and versions.read(spark, folder).first()["author"] == "a"


def test_writers_that_meet(spark, folder):
    first = versions.rebuilt(spark, folder, works(spark, (1, "a", "t", 1, "T")))
    versions.publish(works(spark, (2, "b", "u", 2, "U")), folder, after=first)
    with pytest.raises(versions.Conflict):
        versions.publish(works(spark, (3, "c", "v", 3, "V")), folder, after=first)
    assert versions.read(spark, folder).first()["author"] == "b"
    met = []

    def change(old):
        if not met:
            met.append(versions.publish(works(spark, (4, "d", "x", 4, "X")), folder, after=versions.version(folder)))
        return old.unionByName(works(spark, (5, "e", "y", 5, "Y")))

    versions.changed(spark, folder, change)
    assert {r["author"] for r in versions.read(spark, folder).collect()} == {"d", "e"} and versions.versions(folder) == [1, 2, 3, 4]


def test_a_second_run_extracts_no_page(spark, tmp_path):
    import os

    root, cache = tmp_path / "docs", f"file://{tmp_path}/cache"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.txt").write_text("one\fpage two of " + str(i))
    (root / "bad.txt").write_text("broken")
    log = tmp_path / "log"

    def extract(content):
        with log.open("ab") as f:
            f.write(b"x")
        if content == b"broken":
            raise ValueError
        return content.decode().split("\f")

    def run():
        before = log.stat().st_size if log.exists() else 0
        pages = files.cached_pages(spark, cache, files.document_files(spark, str(root), ("txt",)), extract).collect()
        return len(pages), len({r["key"] for r in pages}), (log.stat().st_size if log.exists() else 0) - before

    assert run()[:2] == (8, 8)
    assert run()[2] <= 2  # only the file that fails, for the look whether there is any and for the try
    (root / "1.txt").write_text("new")
    os.utime(root / "1.txt", (2_000_000_000, 2_000_000_000))
    (root / "5.txt").write_text("a\fb\fc")
    assert run()[:2] == (6 + 1 + 3, 10)
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{cache}/").count() == 12
    (root / "bad.txt").unlink()
    assert run() == (10, 10, 0)


def test_paragraphs_by_index_or_by_text(spark):
    now = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "x"), (2, 0, "a")], "d int, i int, text string")
    before = spark.createDataFrame([(1, 0, "old"), (1, 7, "b"), (1, 9, "b"), (1, 8, "a"), (3, 0, "a")], "d int, i int, text string")
    assert sorted(map(tuple, citations.same_paragraphs(now, before, "d", "i", "text").collect())) == [(1, 0, 0), (1, 1, 7), (1, 2, 9)]
