"""Token ids of whole texts by a public tokenizer, with the ids of frequent parts of words kept in flat tables."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import U, Words


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ORDINALS = np.arange(256)
#: Bytes that part words: ASCII blanks. Other white space is left to the tokenizer.
_BLANK = np.isin(_ORDINALS, [9, 10, 11, 12, 13, 32])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_MARK = (_ORDINALS > 32) & (_ORDINALS < 127) & ~_ALNUM
#: An apostrophe may open a contraction, which takes the letter after it.
_BEFORE_WORD = _MARK & (_ORDINALS != ord("'"))
_LOWER = np.where((_ORDINALS >= 65) & (_ORDINALS <= 90), _ORDINALS + 32, _ORDINALS).astype(np.uint8)

# The parts of a tokenizer whose ids for a text are those of its parts in a row.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _by_parts(tokenizer: Tokenizer) -> bool:
    """If the tokenizer drops blanks and case and never reaches across a blank or from an ASCII letter or digit to an ASCII mark."""
    whole = json.loads(tokenizer.to_str())
    normalizer, pre = whole["normalizer"] or {}, (whole["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    plain = all(whole[k] is None for k in ("truncation", "padding", "post_processor"))
    special = all(t["special"] and not t["normalized"] for t in whole["added_tokens"])
    return plain and special and normalizer.get("normalizers") == _NORMALIZERS and pre[0].get("pattern") == {"Regex": _SPLIT} and pre[0].get("behavior") == "Removed" and not pre[-1].get("use_regex", True) and not (whole["model"].get("dropout") or whole["model"].get("ignore_merges"))


class _Parts(Words):
    """Parts of texts between blanks, cut also where ASCII letters or digits and ASCII marks meet."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, _BLANK, lower=False, fold=_LOWER, cut=self._cut)

    @staticmethod
    def _cut(raw: np.ndarray) -> np.ndarray:
        """Where a part begins although no blank is before it."""
        before, after = raw[:-1], raw[1:]
        return np.concatenate([[False], (_ALNUM[before] & _MARK[after]) | (_BEFORE_WORD[before] & _ALNUM[after])]) if len(raw) else np.zeros(0, bool)


class WordEncoder:
    """Ids of texts as the library gives them, with each different part encoded once.

    Ids of parts are kept in flat tables by 64-bit hash and length, up to KEPT parts; when there are more, the
    later half goes, as frequent parts come early. A text that holds the string of a special token, and every
    text for a tokenizer of another kind, goes to the library as a whole.
    """

    KEPT, LONGEST = 1 << 19, 48

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_parts = _by_parts(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hash, self.size = np.zeros(0, U), np.zeros(0, np.uint16)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.ids = np.zeros(0, self.dtype)
        #: Sorted hashes and their rows: of most parts, and of those learnt lately.
        self.sorted = [self._by_hash(0, 0), self._by_hash(0, 0)]

    @property
    def dtype(self) -> np.dtype:
        """The least unsigned type that holds every id."""
        return np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _library(self, texts: list[str], as_text: bool) -> list[np.ndarray]:
        """Ids by the library; as_text: strings of special tokens are ordinary text."""
        self.tokenizer.encode_special_tokens = as_text
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of the tables, -1 for parts that aren't there."""
        found = np.full(len(hashes), -1)
        for known, rows in self.sorted:
            if len(known):
                row = rows[np.minimum(np.searchsorted(known, hashes), len(known) - 1)]
                found = np.where((self.hash[row] == hashes) & (self.size[row] == sizes), row, found)
        return found

    def _learn(self, hashes: np.ndarray, sizes: np.ndarray, ids: list[np.ndarray]) -> None:
        count = np.array([len(x) for x in ids], np.uint16)
        first = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        self.hash, self.size = np.concatenate([self.hash, hashes]), np.concatenate([self.size, sizes.astype(np.uint16)])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *ids])
        if len(self.hash) > self.KEPT:
            half = self.KEPT // 2
            self.ids = self.ids[: self.first[half]].copy()
            self.hash, self.size, self.first, self.count = (x[:half].copy() for x in (self.hash, self.size, self.first, self.count))
            self.sorted = [self._by_hash(0, half), self._by_hash(half, half)]
            return
        n, most = len(self.hash), len(self.sorted[0][0])
        if n - most > max(1 << 14, most // 4):
            self.sorted[0], most = self._by_hash(0, n), n
        self.sorted[1] = self._by_hash(most, n)

    def _by_hash(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.hash[lo:hi])
        return self.hash[lo:hi][order], (lo + order).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) in a row, and where each text's begin in them."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool) if self.by_parts else np.ones(len(texts), bool)
        for token in self.special if self.by_parts else ():
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_parts(texts)
        whole = self._library(texts.filter(pa.array(odd)).to_pylist(), as_text=False)
        ids, at = self._encode_parts(texts.filter(pa.array(~odd)))
        parts, rest = iter(whole), iter([ids[a:b] for a, b in zip(at, at[1:], strict=False)])
        each = [next(parts) if o else next(rest) for o in odd]
        return np.concatenate([ids[:0], *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

    def _encode_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = _Parts(texts)
        if not len(w.hash):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        hashes, example, of = np.unique(w.hash, return_index=True, return_inverse=True)
        begin, end = w.start[example], w.end[example]
        size = end - begin
        row = self._find(hashes, size)
        new = np.flatnonzero(row < 0)
        data, extra = w.raw.tobytes(), []
        if len(new):
            found = self._library([data[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)], as_text=True)
            extra = found
        count = np.zeros(len(hashes), np.int64)
        count[row >= 0] = self.count[row[row >= 0]]
        count[new] = [len(x) for x in extra]
        first = np.zeros(len(hashes), np.int64)
        first[row >= 0] = self.first[row[row >= 0]]
        first[new] = len(self.ids) + np.cumsum(count[new]) - count[new]
        pool = np.concatenate([self.ids, *extra])
        lengths = count[of]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(first[of] - total[:-1], lengths) + np.arange(total[-1])]
        keep = new[size[new] <= self.LONGEST]
        if len(keep):
            kept = set(keep.tolist())
            self._learn(hashes[keep], size[keep], [x for i, x in zip(new.tolist(), extra, strict=True) if i in kept])
        return ids, total[w.first]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The one for this file that a Python worker keeps."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
