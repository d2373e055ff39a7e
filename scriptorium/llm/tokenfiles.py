"""Flat files of unsigned token ids with 64-bit document offsets, written by partition and read back memory-mapped.

A folder holds, for each range of doc_id, `<name>.bin` (ids, unsigned 16-bit where the vocabulary allows,
else 32-bit, little-endian), `<name>.doc` (doc_id, int64) and `<name>.idx` (uint64 offsets of documents in
the whole corpus, one more than documents), and a table `manifest` of the files in order with each one's
base. Bases are prefix sums over the files' totals.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, plain_documents, steps
from .tokens import encoder

WRITTEN = "name string, part int, n_docs long, n_ids long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _put(folder: str, name: str, data: bytes) -> None:
    """A file that appears as a whole or not at all, however many attempts write it."""
    fs, path = pafs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


def _get(folder: str, name: str, dtype: str) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        size = fs.get_file_info(f"{path}/{name}").size
        return np.memmap(f"{path}/{name}", dtype, "r") if size else np.zeros(0, dtype)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int, folder: str | None = None) -> str:
    """Write the ids of every text (null: empty), each followed by end_id, in ascending doc_id order; the folder.

    Rows with the same doc_id, or none (-1), stand in the order of a hash of their texts. Repeated rows are written each time. No
    rows: a manifest without files. Extra columns are ignored. Every attempt of a task writes files of its
    own; only those named in the manifest, written once, count.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    pafs_, path = pafs.FileSystem.from_uri(folder)
    pafs_.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = encoder(tokenizer), uuid.uuid4().hex
        fs, at = pafs.FileSystem.from_uri(folder)
        ids_out, doc_ids, lengths = None, [], []
        for piece in steps(batches):
            if ids_out is None:
                ids_out = fs.open_output_stream(f"{at}/{name}.bin", buffer_size=1 << 20)
            doc_ids.append(piece.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8"))
            ids, at_ids = enc.encode(piece.column("text"))
            lengths += (np.diff(at_ids) + 1).tolist()
            ids_out.write(np.insert(ids, at_ids[1:], end_id).tobytes())
        if ids_out is None:
            return
        ids_out.close()
        doc = np.concatenate(doc_ids)
        _put(folder, f"{name}.doc", doc.tobytes())
        _put(folder, f"{name}.len", np.array(lengths, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_docs": [len(doc)], "n_ids": [sum(lengths)], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    # The hash lets a range of rows with one doc_id, or none, be cut.
    hashed = plain_documents(docs).withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(write, WRITTEN).write.parquet(f"{folder}/written")
    # One row for each file, so the running total over all of them is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(WRITTEN).parquet(f"{folder}/written").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files.write.parquet(f"{folder}/manifest")

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                lengths = np.asarray(_get(folder, f"{row.name}.len", "<u8"))
                _put(folder, f"{row.name}.idx", (np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row.base)).tobytes())
            yield pdf[["name"]]

    _spread(spark, folder).mapInPandas(index, "name string").write.format("noop").mode("overwrite").save()
    return folder


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, a file to a partition."""
    files = spark.read.schema(f"{WRITTEN}, base long").parquet(f"{folder}/manifest")
    return files.repartition(max(1, files.count()))


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit little-endian ids) and, if asked for, those ids as bytes."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                ids = _get(folder, f"{row.name}.bin", "<u2" if row.width == 2 else "<u4")
                doc, at = _get(folder, f"{row.name}.doc", "<i8"), _get(folder, f"{row.name}.idx", "<u8").astype(np.int64)
                for lo in range(0, len(doc), 512):
                    hi = min(lo + 512, len(doc))
                    own = [ids[at[i] - row.base : at[i + 1] - row.base].astype("<u4").tobytes() for i in range(lo, hi)]
                    yield pd.DataFrame({"doc_id": doc[lo:hi], "start": at[lo:hi], "n_tokens": np.diff(at[lo : hi + 1]), "ids_crc32": [zlib.crc32(x) for x in own], "ids": own if with_ids else None})

    found = _spread(spark, folder).mapInPandas(read, READ)
    return found if with_ids else found.drop("ids")
