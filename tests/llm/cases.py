"""Small tables of awkward rows that every operator has to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, kept string, spans string"


def prose(seed: int, n: int, alphabet: str = "abcdefghijklmnop") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, clashing column names."""
    passage, long = prose(1, 80), prose(2, 30_000)
    texts = {1: prose(3, 120), 2: prose(3, 120), 3: "", 4: None, 5: "   \n\t ", 6: "one", 7: "Ünï côdé — 漢字 🙂", 8: long, 9: prose(4, 30) + " " + passage, 10: passage + " " + prose(5, 40), 11: "### $$$ %%%", 12: "x" * 5000}
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t), i, "x", None) for i, t in texts.items()]
    rows += [rows[0], rows[0], (1, prose(6, 60), "de", "src1", None, None, None, None), (None, prose(7, 60), "en", "src1", 3, 1, "y", "z"), (None, None, None, None, None, None, None, None)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
