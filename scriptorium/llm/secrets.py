"""Secret scan with corpus-wide ownership: how many repositories and owners carry the same candidate.

Candidates are found in every whole text. Their hashes are counted by distinct repository and owner over
all documents: a value that many owners carry is a copied example, one that a single owner carries and
that looks random is live-looking. Counts first reduce (value, repository, owner) and only then value, so
a value in a third of all documents is no large group.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, plain_documents, staged, steps


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the contract: kind, pattern, group that counts, its least length.
BASE = (
    ("assign", re.compile("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Kinds that the method adds: token prefixes and block headers with public formats.
ADDED = (
    ("prefixed", re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})"), 0, 16),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 26),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}"), 0, 32),
)
KINDS = [k for k, *_ in (*BASE, *ADDED)]
SPAN = "struct<kind: string, start: int, end: int, value: string, bits: double>"
#: A value carried by more owners than this is a copied example.
COPIED_OWNERS = 2
#: Bits of Shannon entropy a character from which a value looks random.
RANDOM_BITS = 2.5
WIDELY, LIVE, WEAK = "copied", "live", "weak"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end (code points, end exclusive) and the secret part, by start and then kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate((*BASE, *ADDED)):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end(), m[group]))
    return [(kind, start, end, value) for start, _, kind, end, value in sorted(found)]


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def scan(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the text's key and all candidate spans (value: its SHA-256, never the secret itself)."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("bits", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            spans = [[{"kind": k, "start": a, "end": b, "value": digest(v), "bits": entropy(v)} for k, a, b, v in find_spans(t or "")] for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: piece.column(n) for n in piece.schema.names if n != "text"} | {"spans": pa.array(spans, pa.list_(span))})

    plain = plain_documents(docs, *carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "text")
    return plain.mapInArrow(run, f"{schema}, spans array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners, copies: distinct carriers of each candidate over the corpus."""
    each = found.select("repo", "owner", F.explode(F.array_distinct(F.col("spans.value"))).alias("value"))
    reduced = each.groupBy("value", "owner", "repo").agg(F.count("*").alias("copies"))
    owners = reduced.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("copies").alias("copies"))
    return owners.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("copies").alias("copies"))


def _judged(docs: DataFrame, repo: Column | None, owner: Column | None) -> DataFrame:
    """doc_id, text_hash and verdicts of each row of docs."""
    repo = F.col("source") if repo is None else repo
    owner = F.col("source") if owner is None else owner
    unknown = F.lit("unknown")
    named = docs.select("doc_id", "text", _text_hash("text").alias("text_hash"), F.coalesce(repo.cast("string"), unknown).alias("repo"), F.coalesce(owner.cast("string"), unknown).alias("owner"))
    found = staged(scan(named, "text_hash", "repo", "owner"), "spans")
    has = found.where(F.size("spans") > 0)
    carriers = ownership(has)
    verdict = F.when(F.col("owners") > COPIED_OWNERS, WIDELY).when(F.col("bits") >= RANDOM_BITS, LIVE).otherwise(WEAK)
    # One row for each span of each different text; only rows with spans are regrouped.
    key = ["doc_id", "text_hash"]
    spans = staged(
        has.select(*key, F.inline("spans")).distinct().join(carriers.hint("merge"), "value").select(*key, F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("order"), "kind", "end", "value", verdict.alias("verdict"), "repositories", "owners").alias("span")),
        "verdicts",
    )
    listed = spans.groupBy(*key).agg(F.sort_array(F.collect_list("span")).alias("verdicts"))
    with_spans = has.select(*key).join(listed, key)
    empty = F.array().cast(with_spans.schema["verdicts"].dataType)
    return with_spans.union(found.where(F.size("spans") == 0).select(*key, empty.alias("verdicts")))


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def secrets(docs: DataFrame, *, repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, spans (with the verdict and the counts of each value's carriers).

    verdict: `copied` if more than COPIED_OWNERS owners carry the value, else `live` if it looks random,
    else `weak`. repo and owner are columns; nulls are one repository or owner, named `unknown`. Null and
    empty texts have no spans. A null doc_id is -1. Repeated rows keep a row each. Extra columns are ignored.
    No rows: no rows.
    """
    return _judged(docs, repo, owner).drop("text_hash")


def redacted(docs: DataFrame, *, repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """docs with the secret spans that aren't copied examples replaced by `<secret>`.

    All rows stay, repeated ones too, and all columns, whatever their names; a null doc_id stays null, a null
    text too. No rows: no rows.
    """
    bad = _judged(docs, repo, owner).select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.filter("verdicts", lambda s: s["verdict"] != WIDELY)["value"])).alias("values")).where(F.size("values") > 0)
    own_id, own_hash, values = (free_name(n, *docs.columns) for n in ("redacted_id", "redacted_hash", "redacted_values"))
    known = staged(bad.distinct().toDF(own_id, own_hash, values), "redactions")
    keyed = docs.withColumns({own_id: F.coalesce("doc_id", F.lit(-1)).cast("long"), own_hash: _text_hash("text")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches):
            texts = piece.column("text").to_pylist()
            for i, bad_values in enumerate(piece.column(values).to_pylist()):
                if bad_values and texts[i]:
                    texts[i] = blank_out(texts[i], set(bad_values))
            yield pa.RecordBatch.from_pydict({n: pa.array(texts, pa.string()) if n == "text" else piece.column(n) for n in piece.schema.names if n != values})

    return keyed.join(known, [own_id, own_hash], "left").select(*docs.columns, values).mapInArrow(run, docs.schema)


def blank_out(text: str, values: set[str]) -> str:
    out, at = [], 0
    for _, start, end, value in find_spans(text):
        if digest(value) in values and end > at:
            out += [text[at : max(at, start)], "<secret>"]
            at = end
    return "".join([*out, text[at:]])
