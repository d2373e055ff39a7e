"""CSV as people write it: records with quoted line breaks, read in splits whose quoting is known before they are parsed.

What a quote does depends on all quotes before it, so a split can't tell by itself where its records begin.
A data source reads each split once and gives the state in which it ends for each state in which it may begin;
composing these by file, a few bytes for each split, tells every split its true first state. Then the splits
are parsed where they lie, each with the records that begin in it.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a split.
SPLIT = 32 << 20
#: Bytes of a file's head, from which heading and delimiter are read.
HEAD = 1 << 20
# Characters that stand for plain quotes and apostrophes.
PLAIN = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'"}
_QUOTES = re.compile(b"|".join([b'"', *(k.encode() for k, v in PLAIN.items() if v == '"')]))
_QUOTE = re.compile(b'"')
_BOM = b"\xef\xbb\xbf"
#: States before a byte: outside of quotes, inside, and inside right after a quote, which ends the field or is half of a doubled one.
OUT, IN, HALF = 0, 1, 2


def plain_quotes(text: str) -> str:
    """Plain quotes and line breaks."""
    return text.translate(str.maketrans(PLAIN)).replace("\r\n", "\n").replace("\r", "\n")


class Scan:
    """The quotes of bytes from a place of a file on. before: the byte in front, none at a file's start."""

    def __init__(self, raw: bytes, before: bytes, delimiter: str, plain: bool):
        self.raw, self.before, self.opening = raw, before, (delimiter.encode(), b"\n", b"\r", b"")
        self.quotes = [m.span() for m in (_QUOTES if plain else _QUOTE).finditer(raw)]

    def run(self, state: int) -> tuple[int, list[int], list[int]]:
        """The state at the end, and where quoting begins and ends in between."""
        begins, ends, last = [0] if state != OUT else [], [], 0
        for start, end in self.quotes:
            if state == HALF:
                if start == last:
                    state = IN
                    continue
                ends.append(last)
                state = OUT
            if state == IN:
                state, last = HALF, end
            elif (self.raw[start - 1 : start] if start else self.before) in self.opening:
                state = IN
                begins.append(end)
        if state == HALF and last != len(self.raw):
            ends.append(last)
            state = OUT
        return state, begins, ends

    def record_ends(self, state: int) -> np.ndarray:
        """Where a line break outside of quotes has just passed."""
        data = np.frombuffer(self.raw, np.uint8)
        breaks = data == 10
        breaks[:-1] |= (data[:-1] == 13) & (data[1:] != 10)
        if len(data) and data[-1] == 13:
            breaks[-1] = True
        at = np.flatnonzero(breaks)
        _, begins, ends = self.run(state)
        inside = np.searchsorted(np.array(begins, np.int64), at, "right") > np.searchsorted(np.array(ends, np.int64), at, "right")
        return at[~inside] + 1


def _read(path: str, start: int, end: int) -> bytes:
    fs, own = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(own) as f:
        return f.read_at(max(0, end - start), start)


def _aligned(path: str, start: int, end: int, size: int) -> tuple[int, int, bytes, bytes]:
    """The split moved forward to borders of characters: start, end, its bytes, and the byte before it."""
    raw = _read(path, max(0, start - 1), min(size, end + 3))
    offset = start - max(0, start - 1)
    lead = lambda i: next((k for k in range(i, min(i + 3, len(raw))) if not 0x80 <= raw[k] < 0xC0), min(i + 3, len(raw)))
    a = lead(offset) if start else 0
    b = lead(offset + end - start) if end < size else len(raw)
    if not start and raw.startswith(_BOM):
        a = 3
    base = max(0, start - 1)
    return base + a, base + max(a, b), raw[a : max(a, b)], raw[a - 1 : a] if start else b""


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class QuotedSplits(DataSource):
    """spark.read.format("quoted_splits"): path, start, end, size, ends of each split of text files; ends has the state at its end for each state at its start.

    Options: path (a file or a folder, which is read without those below), bytes of a split, delimiter, plain ("true": typographic quotes count).
    """

    @classmethod
    def name(cls) -> str:
        return "quoted_splits"

    def schema(self) -> str:
        return "path string, start long, end long, size long, ends array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SplitReader(dict(self.options))


class _SplitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("bytes", SPLIT))
        self.delimiter, self.plain = options.get("delimiter", ","), options.get("plain", "true") == "true"

    def partitions(self) -> list[_Split]:
        return [_Split(path, at, min(size, at + self.bytes), size) for path, size in text_files(self.path) for at in range(0, size, self.bytes)] or [_Split("", 0, 0, 0)]

    def read(self, partition: _Split) -> Iterator[tuple]:
        if not partition.path:
            return
        start, end, raw, before = _aligned(partition.path, partition.start, partition.end, partition.size)
        scan = Scan(raw, before, self.delimiter, self.plain)
        yield partition.path, start, end, partition.size, [scan.run(s)[0] if raw else s for s in (OUT, IN, HALF)]


def text_files(path: str) -> list[tuple[str, int]]:
    """Address and size of a file, or of the files right in a folder but for hidden ones, in order."""
    fs, own = pafs.FileSystem.from_uri(path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}")
    scheme = path[: path.index(own)] if own in path and re.match(r"[a-z0-9+.-]+:", path) else "file://"
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(own)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
    return sorted((scheme + x.path, x.size) for x in found)


def head(path: str) -> str:
    """The first HEAD bytes of the first file that isn't empty, without a BOM."""
    for name, size in text_files(path):
        if size:
            return _read(name, 0, min(size, HEAD)).removeprefix(_BOM).decode(errors="ignore")
    return ""


def sniffed_delimiter(text: str, marks: str = ",;\t|") -> str:
    """The mark that Python's csv module guesses from the first 4,096 characters; a comma where it can't tell."""
    try:
        return csv.Sniffer().sniff(text[:4096], delimiters=marks).delimiter
    except csv.Error:
        return ","


def browser_delimiter(text: str) -> str:
    """The semicolon only if the first five lines have strictly more of them than commas."""
    first = "\n".join(re.split(r"\r?\n", text)[:5])
    return ";" if first.count(";") > first.count(",") else ","


def records(spark: SparkSession, path: str, delimiter: str, width: int, *, plain: bool = True, split: int = SPLIT, shape=None, names: list[str] | None = None) -> DataFrame:
    """Records of CSV files as text columns, each file's first record and empty lines left out.

    shape: from a record to its `width` fields; by default short ones are padded and further fields dropped. Quoted fields may hold delimiters,
    doubled quotes and line breaks. Wrong UTF-8 is an error. Files of any size are read in splits of `split` bytes; a task
    holds one split and the rest of its last record.
    """
    spark.dataSource.register(QuotedSplits)
    splits = spark.read.format("quoted_splits").option("bytes", split).option("delimiter", delimiter).option("plain", str(plain).lower()).load(path)

    def states(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        state, out = OUT, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[state])
        return pdf.assign(state=out)[["path", "start", "end", "size", "state"]]

    known = splits.groupBy("path").applyInPandas(states, "path string, start long, end long, size long, state int")
    names = names or [f"_c{i}" for i in range(width)]
    shape = shape or (lambda row: (row + [""] * (width - len(row)))[:width])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for pdf in frames:
            for path, start, end, size, state in pdf.itertuples(index=False):
                rows = [shape(r) for r in own_records(path, start, end, size, state, delimiter, plain) if r]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=names, dtype=object)

    one_each = known.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")
    return one_each.mapInPandas(parse, StructType([StructField(n, StringType()) for n in names]))


def own_records(path: str, start: int, end: int, size: int, state: int, delimiter: str, plain: bool) -> list[list[str]]:
    """The records that begin in a split, but for the first of the file."""
    if start >= end:
        return []
    raw, before, more = _read(path, start, end), _read(path, start - 1, start) if start > 3 else b"", 1 << 16
    first = start == 0 or start == 3 and _read(path, 0, 3) == _BOM
    if not first and not before:
        before = _read(path, start - 1, start)
    while True:
        scan = Scan(raw, b"" if first else before, delimiter, plain)
        ends = scan.record_ends(state)
        done = start + len(raw) >= size
        past = ends[ends >= end - start]
        if len(past) and (past[0] < len(raw) or done) or done:
            break
        raw += _read(path, start + len(raw), min(size, start + len(raw) + more))
        more *= 2
    begins = ends[ends < end - start]
    if not first and begins_here(raw, before, state):
        begins = np.concatenate([[0], begins])
    if not len(begins):
        return []
    stop = int(past[0]) if len(past) else len(raw)
    text = raw[int(begins[0]) : stop].decode()
    return list(csv.reader(io.StringIO(plain_quotes(text) if plain else text.replace("\r\n", "\n").replace("\r", "\n"), newline=""), delimiter=delimiter))


def begins_here(raw: bytes, before: bytes, state: int) -> bool:
    """If a record begins with the first byte of a split: a line break is right before it, outside of quotes."""
    return state != IN and (before == b"\n" or before == b"\r" and raw[:1] != b"\n") and not (state == HALF and raw[:1] == b'"')
