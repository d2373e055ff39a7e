"""The registered queries on whole small tables against plain Python, and the filtering stages on clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from scriptorium.llm import decontamination, minhash, queries, secrets, toxicity

from .cases import SCHEMA, awkward, table
from .test_operators import brute_base, encoded, words

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@needs_data
def test_op2_and_op3_hold_the_ids_of_the_library(spark, texts):
    at = 0
    for r in sorted(queries.op3_tokens(spark, DATA).collect(), key=lambda r: r["doc_id"]):
        ids = encoded(texts[r["doc_id"]], 1)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    covered, sequences = Counter(), defaultdict(list)
    for r in queries.op2_packing(spark, DATA).collect():
        ids = encoded(texts[r["doc_id"]], 2)
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: len(encoded(t, 2)) for i, t in texts.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


@needs_data
def test_op4_base_columns(spark, texts):
    for r in queries.op4_quality(spark, DATA).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


@needs_data
def test_op5_sizes_and_slots(spark, texts):
    slots, sizes = defaultdict(list), Counter()
    for r in queries.op5_resharding(spark, DATA).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(texts)


@needs_data
def test_op7_base_digest(spark, texts):
    kinds = (("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    for r in queries.op7_secrets(spark, DATA).collect():
        found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]]) if len(m[g]) >= least]
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[2] == kind for f in found) for kind, *_ in kinds)


@needs_data
def test_op8_and_op10_on_held_out_rows(spark, texts):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    scored = {r["doc_id"]: r for r in queries.op8_toxicity(spark, DATA).collect()}
    assert scored.keys() == texts.keys() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in scored.items())
    judged = [(labels[i], r["predicted"]) for i, r in scored.items() if labels.get(i) is not None]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    told = [(langs[r["doc_id"]], r["lang_pred"]) for r in queries.op10_language(spark, DATA).collect() if r["held_out"] and langs[r["doc_id"]] and texts[r["doc_id"]].strip()]
    assert sum(a == b for a, b in told) / len(told) > 0.95


@needs_data
def test_op1_holds_every_pair_of_shared_texts(spark, texts):
    """Exact copies are of one class, and no class joins texts that share no shingle with any other of it."""
    got = {r["doc_id"]: r["class_id"] for r in queries.op1_minhash(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    by_text, members = defaultdict(set), defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i])
        members[got[i]].add(t)
    assert all(len(x) == 1 for x in by_text.values())
    bag = lambda t: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(max(1, len(w) - 4))}
    for own in members.values():
        bags = [bag(t) for t in own]
        assert len(bags) == 1 or all(any(a & b for b in bags if b is not a) for a in bags)


CLASHES = ("_id", "_hash", "_key", "_values", "kept_id", "contaminated_hash", "redacted_values", "h", "value", "seed", "rank", "score", "class_id")


@pytest.mark.parametrize("rows", ["awkward", "none"])
def test_filtering_stages_keep_columns_of_any_name(spark, rows):
    data = [(*r, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(awkward())] if rows == "awkward" else []
    docs = spark.createDataFrame(data, SCHEMA + "".join(f", `{c}` string" for c in CLASHES))
    bench = table(spark, [r for r in awkward() if r[0] == 9]).selectExpr("doc_id as item_id", "text")
    labels = spark.createDataFrame([(i, int(i == 12)) for i in range(1, 13)], "doc_id long, toxic int")
    stages = {
        "dedup": minhash.deduplicated(docs), "decontaminated": decontamination.decontaminated(docs, bench),
        "redacted": secrets.redacted(docs), "toxic": toxicity.without_toxic(docs, labels),
    }
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        got = out.collect()
        assert (len(got) > 0) == bool(data) and {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}, name
    assert secrets.redacted(docs).count() == len(data)
    assert {r["doc_id"] for r in stages["decontaminated"].collect()} == {r[0] for r in data if r[0] != 9}
