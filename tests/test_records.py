"""CSV in splits against Python's csv module over whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from scriptorium.sources import files, records


def whole(text: str, mark: str, plain: bool) -> list[list[str]]:
    text = records.plain_quotes(text) if plain else text.replace("\r\n", "\n").replace("\r", "\n")
    return [r for r in list(csv.reader(io.StringIO(text, newline=""), delimiter=mark))[1:] if r]


def in_splits(path: str, size: int, split: int, mark: str, plain: bool) -> list[list[str]]:
    """What the data source and the parser do, one split after another."""
    reader = records._SplitReader({"path": path, "bytes": split, "delimiter": mark, "plain": str(plain).lower()})
    state, rows = records.OUT, []
    for p in reader.partitions():
        for own, start, end, total, ends in reader.read(p):
            rows += [r for r in records.own_records(own, start, end, total, state, mark, plain) if r]
            state = ends[state]
    return rows


@pytest.mark.parametrize("plain", [True, False])
def test_splits_of_any_size_equal_the_whole(tmp_path, plain):
    rng = random.Random(7)
    pieces = ['"', '"', '""', ";", ";", "\n", "\r\n", "\r", "a", "bc", " ", "ü", "„", "“", "»", "漢", '";"', '"x\ny";', "5\" "]
    for k in range(400):
        text = "h1;h2\n" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        raw = ("﻿" if k % 3 == 0 else "").encode() + text.encode()
        path = tmp_path / f"{plain}{k}.csv"
        path.write_bytes(raw)
        for split in (1, 2, 3, 5, 8, 17, 1000):
            assert in_splits(str(path), len(raw), split, ";", plain) == whole(text, ";", plain), (text, split)


def test_quoted_line_breaks_over_splits(spark, tmp_path):
    want = [(f"w{i}", f"line one of {i}\nline \"two\"; {i}" * (i % 7), "x" * (i % 50)) for i in range(3000)]
    with (tmp_path / "a.csv").open("w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter=";").writerows([("Werk", "Notizen", "Rest"), *want, ("Werk", "Notizen", "Rest")])
    got = files.sanitized_csv(spark, str(tmp_path / "a.csv"), split=20_000)
    assert sorted(map(tuple, got.collect())) == sorted([tuple(c.strip() for c in r) for r in want] + [("Werk", "Notizen", "Rest")])
    assert spark.read.format("quoted_splits").option("bytes", 20_000).option("delimiter", ";").load(str(tmp_path / "a.csv")).count() > 5


def test_several_files_and_delimiters(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n\n3\n")
    (folder / "2.csv").write_text("a,b\n\"4\n5\",6,7\n")
    assert sorted(map(tuple, files.browser_csv(spark, str(folder)).collect())) == [("1", "2"), ("3", ""), ("4\n5", "6")]
    assert sorted(map(tuple, files.sanitized_csv(spark, str(folder)).collect())) == [("1", "2"), ("3", ""), ("4\n5", "6 | EXTRA: 7")]
    assert records.browser_delimiter("a;b\n1,2") == "," and records.browser_delimiter("a;b;c\n1,2") == ";"
    assert records.browser_delimiter("a,b\n" + "x,y\n" * 4 + ";" * 90) == ","
    (tmp_path / "m.csv").write_text("author;page\nKern;3\n")
    (tmp_path / "t.csv").write_text("author\tpage\nKern\t3\nBock\t4\n")
    for name in ("m.csv", "t.csv"):
        got = files.mentions_csv(spark, str(tmp_path / name), ("author", "page"))
        assert got.columns == ["author", "page"] and ("Kern", "3") in {tuple(r) for r in got.collect()}
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "rowless.csv").write_text("a;b\n")
    for name in ("empty.csv", "rowless.csv"):
        with pytest.raises(ValueError, match="empty"):
            files.mentions_csv(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="empty"):
        files.sanitized_csv(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(FileNotFoundError):
        files.sanitized_csv(spark, str(tmp_path / "none.csv"))
