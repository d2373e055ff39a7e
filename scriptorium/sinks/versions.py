"""Tables that are written back: rows in folders of their own, and a numbered pointer that makes a version current.

A version is one or more folders of rows: a change writes all rows anew, an addition a further folder. Rows are written first; only then does its pointer appear, under the next free number, as a whole or not at
all. Whoever reads meanwhile, or after a writer that broke off, sees the version before. A writer that finds its number
taken has met another one and raises Conflict: read again and write again. Each pointer names the runs whose rows are in
it, so that a run that is repeated adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import catalog

POINTERS = "_versions"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Version(NamedTuple):
    number: int
    folders: tuple[str, ...]
    schema: str
    runs: tuple[str, ...]


def _pointers(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, f"{path}/{POINTERS}"


def versions(folder: str) -> list[int]:
    """Numbers of the versions that are there, ascending."""
    fs, path = _pointers(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json") and x.base_name[:-5].isdigit())


def version(folder: str, number: int | None = None) -> Version | None:
    """A version, by default the current one; None where there is none."""
    numbers = versions(folder)
    if not numbers or number is not None and number not in numbers:
        return None
    fs, path = _pointers(folder)
    with fs.open_input_file(f"{path}/{numbers[-1] if number is None else number:012d}.json") as f:
        own = json.loads(f.read())
    return Version(own["number"], tuple(own["folders"]), own["schema"], tuple(own["runs"]))


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """Rows of a version, by default the current one."""
    own = version(folder, number)
    if own is None:
        raise FileNotFoundError(f"no version {'' if number is None else number} in {folder}")
    return spark.read.schema(StructType.fromJson(json.loads(own.schema))).parquet(*[f"{folder}/{x}" for x in own.folders])


def publish(rows: DataFrame, folder: str, *, after: Version | None, run: str | None = None, further: bool = False) -> Version:
    """Write rows as the version after another (None: the first), with a run added to its list. further: beside that version's rows, of the same columns."""
    data, number = f"rows-{uuid.uuid4().hex}", after.number + 1 if after else 1
    if further and after is not None:
        before = StructType.fromJson(json.loads(after.schema))
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in before]:
            raise ValueError(f"columns {rows.schema.simpleString()} and {before.simpleString()}")
    rows.write.parquet(f"{folder}/{data}")
    runs = (*(after.runs if after else ()), *([run] if run else []))
    own = Version(number, (*(after.folders if after and further else ()), data), rows.schema.json(), runs)
    fs, path = _pointers(folder)
    fs.create_dir(path, recursive=True)
    made = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as out:
        out.write(json.dumps(own._asdict()).encode())
    _claim(fs, made, f"{path}/{number:012d}.json", folder)
    return own


def _claim(fs: pafs.FileSystem, made: str, name: str, folder: str) -> None:
    """Give a written pointer its number, unless that is taken. Local folders and HDFS refuse by themselves; elsewhere a look before has to do."""
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        try:
            os.link(made, name)
        except FileExistsError:
            raise Conflict(f"{name} is there already") from None
        finally:
            os.unlink(made)
        return
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(made)
        raise Conflict(f"{name} is there already")
    fs.move(made, name)


def changed(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], *, run: str | None = None, further: bool = False, tries: int = 5) -> Version:
    """Publish what change makes of the current rows (None at first), or, if further, beside them. A run that is in already changes nothing; a conflict starts again."""
    for left in reversed(range(tries)):
        now = version(folder)
        if now is not None and run is not None and run in now.runs:
            return now
        try:
            return publish(change(read(spark, folder, now.number) if now else None), folder, after=now, run=run, further=further)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be above 0")


def upsert(spark: SparkSession, folder: str, rows: DataFrame, keys: tuple[str, ...] = catalog.KEYS, keep_old_if_null: tuple[str, ...] = (), *, run: str | None = None) -> Version:
    """Rows replace those of equal keys, as in catalog.upsert; rows has an id."""
    return changed(spark, folder, lambda old: catalog.upsert(old if old is not None else rows.limit(0), rows, keys, keep_old_if_null), run=run)


def insert_or_ignore(spark: SparkSession, folder: str, rows: DataFrame, *keys: str, run: str | None = None) -> Version:
    """Rows whose keys aren't there are added; of equal keys among them one."""
    return changed(spark, folder, lambda old: catalog.insert_or_ignore(old if old is not None else rows.limit(0), rows, *keys), run=run)


def rebuilt(spark: SparkSession, folder: str, rows: DataFrame, *, run: str | None = None) -> Version:
    """Rows in place of all that was there."""
    return changed(spark, folder, lambda _: rows, run=run)


def added(spark: SparkSession, folder: str, rows: DataFrame, run: str) -> Version:
    """Rows of a run, with its id as run_id, beside those that are there. Tables that share runs are written with the same id; any of them may be repeated."""
    return changed(spark, folder, lambda _: rows.withColumn("run_id", F.lit(run)), run=run, further=True)
