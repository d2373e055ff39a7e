"""The pipeline on a fixture whose every decision is known, and the registered queries on a small scale."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline

from .cases import prose
from .test_operators import changed, encoded

KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents 0 to 299 are clean or toxic; then copies, leaks, secrets, a null and an empty text."""
    at = tmp_path_factory.mktemp("tables")
    item = prose(7000, 40)
    rows = [(i, prose(i, 60) + (" grobian flegel" if i % 6 == 0 else "")) for i in range(300)]
    rows += [(300, rows[1][1]), (301, changed(prose(901, 400), 390)), (302, prose(901, 400))]
    rows += [(310, prose(902, 50) + " " + item + " " + prose(903, 20)), (320, f'{prose(904, 60)} password = "{KEY}" {prose(905, 20)}'), (330, None), (331, ""), (332, prose(906, 9000))]
    docs = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(7001, 30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(rows)


def test_pipeline_keeps_what_it_should(spark, folder):
    sf_dir, texts = folder
    want = {i: t for i, t in texts.items() if not (i < 300 and i % 6 == 0) and i not in (300, 302, 310, 331)}
    want[320] = want[320].replace(f'password = "{KEY}', "<secret>")
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]] += r["length"]
    assert pieces.keys() == want.keys() and max(sequences.values()) <= 4096
    for i, own in pieces.items():
        ids = encoded(want[i], 2)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in own)


def test_packing_stage_returns_the_token_ids(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (1, 320, 330, 332)")
    got = defaultdict(bytes)
    for r in sorted(corpus_pipeline.packing(spark, docs, sf_dir).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += r["ids"]
    assert got == {i: encoded(texts[i], 2).tobytes() for i in (1, 320, 330, 332)}


def test_stages_return_the_columns_of_documents(spark, folder):
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries().keys()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
