"""Alignment of two tokenizers over the same texts: least groups of tokens with equal borders, and how widely token pairs overlap.

A text's tokens under both tokenizers are the nodes of a bipartite graph; two tokens are linked where their
byte ranges overlap. Union-find over the links gives connected components, which are the least groups that
begin and end together; each group's members give its links. Pairs of ids are then counted by document over
the whole corpus. Each document learns the counts of its pairs from a dictionary of its block of documents,
so that what is shuffled by pair grows with the blocks and not with the documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, bounded_batches, staged, steps
from .tokens import tokenizer_path

#: Bytes of text after which a task opens a new block of documents. A longer text is a block of its own.
BLOCK_BYTES = 4 << 20
# The splits of a byte-level tokenizer that never reach across a blank after a visible character.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_NONE = np.zeros(256, bool)
#: Lead bytes of UTF-8 characters of two, three and four bytes among which there is no white space.
_LEAD_2 = np.array([0xC3 <= b <= 0xDF for b in range(256)])
_LEAD_3 = np.array([b == 0xE0 or 0xE4 <= b <= 0xEF for b in range(256)])
_LEAD_4 = np.array([0xF0 <= b <= 0xF4 for b in range(256)])
_VISIBLE = np.array([32 < b < 127 for b in range(256)])


def _cut(raw: np.ndarray) -> np.ndarray:
    """Where a part begins: at a blank right after a character that is surely no white space. Neither tokenizer has a token across it."""
    sure = _VISIBLE[raw].copy()
    for n, lead in ((1, _LEAD_2), (2, _LEAD_3), (3, _LEAD_4)):
        sure[n:] |= lead[raw[:-n]] & (raw[n:] >= 0x80) & (raw[n:] < 0xC0)
    begins = np.zeros(len(raw), bool)
    begins[1:] = (raw[1:] == 32) & sure[:-1]
    return begins


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones for themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairEncoder:
    """Ids of texts by a byte-level tokenizer (A) and a sentence-piece model (B), with each different part of texts encoded once.

    Up to KEPT parts of at most LONGEST bytes are remembered, by 64-bit hash and length; when there are more, all are forgotten.
    """

    KEPT, LONGEST = 1 << 19, 64

    def __init__(self, byte_bpe: str, piece: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece)
        as_byte = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        whole = json.loads(self.a.to_str())
        plain = whole["normalizer"] is None and whole["pre_tokenizer"] == PLAIN and not whole["model"].get("dropout")
        self.lone_blank = self.b.piece_to_id("▁")  # the library gives no piece for a blank at a text's end by itself
        #: Other splits before A, or pieces of B with a blank after another character, would reach across parts; then only whole texts are encoded.
        self.by_parts = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.vocab = max(len(self.a_bytes), len(self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.hash, self.size = np.zeros(0, U), np.zeros(0, np.int64)
        self.first, self.count = np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def parts(self, data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of parts, each of which begins with a blank, in a row and how many each has, by A and by B; none by both where the bytes of either aren't the part's."""
        texts, joined = [x.decode() for x in data], b"".join(data)
        a = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum([len(d) for d in data])
        b = _flat([ids or [self.lone_blank] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)])
        if all(self._spell(own, table, size, ends, joined) for own, table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size))):
            return [a, b]
        good = np.ones(len(data), bool)
        for (own, n), table in ((a, self.a_bytes), (b, self.b_bytes)):
            at = np.cumsum(n)
            good &= [b"".join(map(table.__getitem__, own[x:y])) == d for x, y, d in zip((at - n).tolist(), at.tolist(), data, strict=True)]
        return [(own[np.repeat(good, n)], np.where(good, n, 0)) for own, n in (a, b)]

    @staticmethod
    def _spell(ids: tuple[np.ndarray, np.ndarray], table: list[bytes], size: np.ndarray, ends: np.ndarray, joined: bytes) -> bool:
        """If the ids of each part have the part's bytes."""
        own, n = ids
        return bool((np.cumsum(size[own])[np.cumsum(n) - 1] == ends).all()) and b"".join(map(table.__getitem__, own.tolist())) == joined

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of all texts by both tokenizers, a blank put before each; texts null, empty or changed by a tokenizer have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        blank = pa.scalar(" ", pa.large_string())
        texts = pc.if_else(pa.array(filled), pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())), texts)
        w = Words(texts, _NONE, lower=False, cut=_cut if self.by_parts else None)
        hashes, example, of = np.unique(w.hash, return_index=True, return_inverse=True)
        size = (w.end - w.start)[example]
        row = self._rows(hashes, size)
        new = np.flatnonzero(row < 0)
        good = np.ones(len(hashes), bool)
        count, first = np.zeros((2, len(hashes)), np.int64), np.zeros((2, len(hashes)), np.int64)
        known = row >= 0
        count[:, known], first[:, known] = self.count[:, row[known]], self.first[:, row[known]]
        good[known] = self.count[0, row[known]] > 0
        pools = self.ids
        if len(new):
            raw = w.raw.tobytes()
            found = self.parts([raw[x:y] for x, y in zip(w.start[example[new]].tolist(), w.end[example[new]].tolist(), strict=True)])
            good[new] = found[0][1] > 0
            for side, (_, n) in enumerate(found):
                count[side, new] = n
                first[side, new] = len(self.ids[side]) + np.cumsum(n) - n
            pools = [np.concatenate([pool, own.astype(np.int32)]) for pool, (own, _) in zip(self.ids, found, strict=True)]
        doc = w.doc()
        bad = np.bincount(doc[~good[of]], minlength=len(texts)) > 0
        keep = ~bad[doc]
        of, doc = of[keep], doc[keep]
        ids, docs = [], []
        for side in (0, 1):
            n = count[side, of]
            total = np.cumsum(n)
            ids.append(pools[side][np.repeat(first[side, of] - (total - n), n) + np.arange(total[-1] if len(total) else 0)])
            docs.append(np.repeat(doc, n))
        if len(new):
            self._learn(hashes[new], size[new], found)
        return Encoded(len(texts), ids[0], ids[1], docs[0], docs[1])

    def _rows(self, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of remembered parts, -1 for others."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        row = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[row] == hashes) & (self.size[row] == size), row, -1)

    def _learn(self, hashes: np.ndarray, size: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Remember parts of usual length."""
        if len(self.hash) + len(hashes) > self.KEPT:
            self._forget()
        short = size <= self.LONGEST
        count = np.stack([n[short] for _, n in found])
        first = np.cumsum(count, axis=1) - count + np.array([[len(x)] for x in self.ids])
        self.ids = [np.concatenate([pool, own[np.repeat(short, n)].astype(np.int32)]) for pool, (own, n) in zip(self.ids, found, strict=True)]
        order = np.argsort(np.concatenate([self.hash, hashes[short]]), kind="stable")
        self.hash, self.size = np.concatenate([self.hash, hashes[short]])[order], np.concatenate([self.size, size[short]])[order]
        self.first, self.count = np.concatenate([self.first, first], axis=1)[:, order], np.concatenate([self.count, count], axis=1)[:, order]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Encoded(NamedTuple):
    """Ids of n texts by A and by B in a row, and the text of each."""

    n: int
    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find: the least node of each node's component, for nodes 0 to n - 1 and links u[i] - v[i].

    All links are united at once, the greater root under the least one that it meets; then every path is halved until
    it is flat. Both are repeated until no link joins two roots.
    """
    root = np.arange(n)
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return root
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def overlaps(e: Encoded, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all tokens of A and B whose byte ranges overlap. Both fill the same bytes without gaps, so each stretch between borders is one pair."""
    a_end, b_end = np.cumsum(a_size[e.a]), np.cumsum(b_size[e.b])
    ends = np.zeros((2, (a_end[-1] if len(a_end) else 0) + 1), bool)
    ends[0, a_end] = ends[1, b_end] = True
    border = np.flatnonzero(ends[0] | ends[1])
    before = np.cumsum(ends[:, border], axis=1) - ends[:, border]  # tokens that end before each stretch's last byte
    return before[0], before[1]


class Aligned(NamedTuple):
    """Links as positions in A and B, and the group of each token, counted over all texts."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def align(e: Encoded, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    a, b = overlaps(e, a_size, b_size)
    root = components(len(e.a) + len(e.b), a, b + len(e.a))
    group = np.zeros(len(root), np.int64)
    group[np.unique(root[: len(e.a)])] = 1
    group = (np.cumsum(group) - 1)[root]  # roots are tokens of A: each group has one, and they come first
    return Aligned(a, b, group[: len(e.a)], group[len(e.a) :])


_encoders: dict[tuple[str, str], tuple[PairEncoder, tuple[np.ndarray, np.ndarray]]] = {}


def _encoder(byte_bpe: str, piece: str) -> tuple[PairEncoder, tuple[np.ndarray, np.ndarray]]:
    """The encoder that a Python worker keeps, and its marked ids."""
    key = (byte_bpe, piece)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        e = PairEncoder(byte_bpe, piece)
        _encoders[key] = e, marked_ids(e.vocab)
    return _encoders[key]


def marked_ids(vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id as decimal digits and one of the marks `,` `|` `;` behind: bytes in rows, and how many of a row count. Row: mark x vocab + id."""
    texts = [f"{i}{mark}".encode() for mark in ",|;" for i in range(vocab)]
    width = max(map(len, texts))
    return np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(-1, width), np.array([len(t) for t in texts], np.int64)


def written_groups(e: Encoded, g: Aligned, marked: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`; nothing for texts without tokens."""
    key = np.concatenate([2 * g.a_group, 2 * g.b_group + 1])
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate([e.a, e.b])[order]
    after = np.append(key[1:], -1)
    mark = np.where(after == key, 0, np.where((after == key + 1) & (key % 2 == 0), 1, 2))
    table, length = marked
    row = mark * (len(length) // 3) + ids
    data = table[row][np.arange(table.shape[1]) < length[row][:, None]].tobytes()
    tokens = np.cumsum(np.bincount(e.a_doc, minlength=e.n) + np.bincount(e.b_doc, minlength=e.n))
    ends = np.concatenate([[0], np.cumsum(length[row])])[tokens].tolist()
    return [data[x : max(x, y - 1)] for x, y in zip([0, *ends], ends, strict=False)]


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def token_groups(docs: DataFrame, byte_bpe: str | None = None, piece: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_group, b_group: the ids of every text by both tokenizers, and the group of each, from 0 in each text.

    byte_bpe: a byte-level tokenizer's file; piece: a sentence-piece model. Both get a blank and the text. Tokens of
    one group lie next to each other, and A's tokens of a group fill the same bytes as B's. Texts that are null or
    empty, or whose bytes a tokenizer changes, have empty lists. Repeated rows are kept, a null doc_id stays null,
    extra columns are ignored. No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    byte_bpe, piece = byte_bpe or tokenizer_path("byte_bpe_50k.json"), piece or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _encoder(byte_bpe, piece)
        for batch in steps(batches):
            e = encoder.encode(batch.column("text"))
            g = align(e, encoder.a_size, encoder.b_size)
            first = np.zeros(e.n, np.int64)
            first[e.a_doc[::-1]] = g.a_group[::-1]  # the group of each text's first token
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "a_ids": _lists(e.a, e.a_doc, e.n, pa.int32()), "b_ids": _lists(e.b, e.b_doc, e.n, pa.int32()),
                "a_group": _lists(g.a_group - first[e.a_doc], e.a_doc, e.n, pa.int32()), "b_group": _lists(g.b_group - first[e.b_doc], e.b_doc, e.n, pa.int32()),
            })

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>")


LINKED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _linked(docs: DataFrame, byte_bpe: str, piece: str) -> DataFrame:
    """Of each document: counts, the digest of its groups, and its different linked pairs with how often it has each; block: a run of documents of bounded bytes."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, marked = _encoder(byte_bpe, piece)
        n_b = len(encoder.b_bytes)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in steps(batches):
            size = pc.sum(pc.fill_null(pc.binary_length(batch.column("text")), 0)).as_py()
            if held and held + size > BLOCK_BYTES:
                block, held = block + 1, 0
            held += size
            e = encoder.encode(batch.column("text"))
            g = align(e, encoder.a_size, encoder.b_size)
            doc = e.a_doc[g.a]
            pair = e.a[g.a].astype(np.int64) * n_b + e.b[g.b]
            order = np.lexsort((pair, doc))
            pair, doc = pair[order], doc[order]
            begins = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(begins, len(pair)))
            count = lambda owner: np.bincount(owner, minlength=e.n)
            groups = written_groups(e, g, marked)
            yield pa.RecordBatch.from_pydict({
                "block": np.full(e.n, block), "doc_id": batch.column("doc_id"), "n_a": count(e.a_doc), "n_b": count(e.b_doc),
                "n_groups": count(e.a_doc[np.unique(g.a_group, return_index=True)[1]]), "n_links": count(doc),
                "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in groups],
                "pairs": _lists(pair[begins], doc[begins], e.n, pa.int64()), "times": _lists(times, doc[begins], e.n, pa.int32()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LINKED)


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """pair, count, best of every linked pair of ids: how many documents hold it, and if no pair of its A id is held by more."""
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {n_b}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _summed(links: pa.Table, known: pa.Table) -> pa.Table:
    """A block's documents and its dictionary: the sums that each document takes over its links."""
    order = np.argsort(known.column("pair").to_numpy())
    pair, count, best = (known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "count", "best"))
    lists = links.column("pairs").combine_chunks()
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    own, times = pc.list_flatten(lists).to_numpy(), pc.list_flatten(links.column("times").combine_chunks()).to_numpy().astype(np.int64)
    at = np.searchsorted(pair, own)
    total, bests = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    if len(own):
        np.add.at(total, doc, count[at] * times)
        np.add.at(bests, doc, best[at] * times)
    return pa.table({c: links.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": bests, "count_sum": total, "groups_sha256": links.column("groups_sha256")})


def alignment(docs: DataFrame, byte_bpe: str | None = None, piece: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; token_groups has the groups themselves.

    A link is a pair of token occurrences of A and B that overlap; its count is how many documents hold its pair of
    ids linked; n_best counts links whose count is the highest that their A id has anywhere, ties included. Null and
    empty texts, and those whose bytes a tokenizer changes, have zeros and ''. Repeated rows are documents of their
    own; a null doc_id stays null; extra columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    byte_bpe, piece = byte_bpe or tokenizer_path("byte_bpe_50k.json"), piece or tokenizer_path("piece_bpe_32k.model")
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=piece).get_piece_size()
    links = staged(_linked(docs, byte_bpe, piece), "links")
    blocks = staged(links.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n")), "pairs")
    counts = staged(pair_counts(blocks, n_b), "counts")
    known = blocks.join(counts.hint("merge"), "pair").select("block", "pair", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return links.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, schema)
