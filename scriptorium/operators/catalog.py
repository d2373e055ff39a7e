"""The bibliographic catalogue: lists, filters, upserts, duplicates, library sync, cascades. Every change is a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked

KEYS = ("author_key", "title_key", "year_key")


def year_key(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(-1))


def with_open_acquisitions(works: DataFrame, acquisitions: DataFrame, closed: tuple[str, ...] = ("done",)) -> DataFrame:
    """open_acq: acquisitions of a work that aren't closed, reduced before the join."""
    n = acquisitions.where(~F.col("status").isin(*closed)).groupBy("work_id").agg(F.count("*").alias("open_acq"))
    return works.join(n, works["id"] == n["work_id"], "left").drop("work_id").withColumn("open_acq", F.coalesce("open_acq", F.lit(0)).cast("long"))


def filtered(works: DataFrame, *, owned: bool | None = None, missing: bool | None = None, oa: bool | None = None, needle: str = "") -> DataFrame:
    """All conditions that are given, and the needle in author or title, any case."""
    out = works
    for flag, cond in ((owned, F.col("owned") == 1), (missing, F.col("file_exists") == 0), (oa, F.col("oa") == 1)):
        if flag is not None:
            out = out.where(cond if flag else ~cond)
    if needle:
        n = needle.lower()
        out = out.where(F.contains(F.lower("author"), F.lit(n)) | F.contains(F.lower("title"), F.lit(n)))
    return out


def summary(works: DataFrame) -> DataFrame:
    return works.agg(F.count("*").alias("n_works"), F.count_if(F.col("file_exists") == 1).alias("n_have"), F.count_if(F.col("file_exists") == 0).alias("n_missing"))


def missing_export(works: DataFrame) -> DataFrame:
    """Missing works with what to do: download the open ones, ask for a scan of the others."""
    return works.where("file_exists = 0").withColumn("action", F.when(F.col("oa") == 1, "download").otherwise("scan_request"))


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("c"), F.min("id").alias("keep_id")).where("c > 1")


def keepers(works: DataFrame, *keys: str) -> DataFrame:
    """old_id, keep_id: the least id of each key, reduced first, so that a frequent key is no large group."""
    least = works.groupBy(*keys).agg(F.min("id").alias("keep_id"))
    return works.join(least, list(keys)).select(F.col("id").alias("old_id"), "keep_id")


def dedupe(works: DataFrame, children: dict[str, DataFrame], *keys: str, inherit: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Works without duplicates, and children pointed at the ones kept. An inherited column that the keeper lacks comes from its last duplicate with one."""
    mapping = keepers(works, *keys)
    kept = works.join(mapping.where("old_id = keep_id").select(F.col("old_id").alias("id")), "id", "left_semi")
    if inherit:
        named = works.join(mapping.withColumnRenamed("old_id", "id"), "id")
        last = named.groupBy("keep_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}") for c in inherit])
        kept = kept.join(last, kept["id"] == last["keep_id"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in inherit}).select(*works.columns)
    moved = {name: child.join(mapping, child["work_id"] == mapping["old_id"], "left").withColumn("work_id", F.coalesce("keep_id", "work_id")).select(*child.columns) for name, child in children.items()}
    return kept, moved


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS, keep_old_if_null: tuple[str, ...] = ("author", "title")) -> DataFrame:
    """New rows replace old ones of the same key, but for nulls in the columns named; other old and new rows stay. Of equal keys in new, the last by id counts."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), "id").alias("n"))
    joined = old.join(last, list(keys), "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "id":
            out.append(F.coalesce("id", "n.id").alias("id"))
        elif c in keep_old_if_null:
            out.append(F.coalesce(f"n.{c}", c).alias(c))
        else:
            out.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def insert_or_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def with_new_ids(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids after the largest old one (after 0 if there is none), in the order given, which has to be total."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    placed = ranked(new, [F.col(c) for c in order], "_place").crossJoin(F.broadcast(top))
    return placed.select((F.col("_top") + F.col("_place")).alias("id"), *new.columns)


def get_or_create(old: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """old (id, name) with is_new false, and the different names that it lacks, in order, with new ids after its largest. Null names are none."""
    fresh = names.where(F.col(name).isNotNull()).select(name).distinct().join(old.select(name), name, "left_anti")
    made = with_new_ids(old, fresh, [name]).select("id", name, F.lit(True).alias("is_new"))
    return old.select("id", name, F.lit(False).alias("is_new")).unionByName(made)


def cascade_delete(ids: DataFrame, works: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    gone = ids.select("id").distinct()
    return works.join(gone, "id", "left_anti"), *[c.join(gone.withColumnRenamed("id", "work_id"), "work_id", "left_anti") for c in children]


def sync_library(works: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".pdf", ".epub", ".djvu", ".txt")) -> DataFrame:
    """file_* columns and owned from a listing (stub, ext, size, path): the first extension in order wins; none: not there."""
    order = F.array_position(F.array(*map(F.lit, extensions)), F.lower("ext"))
    best = files.where(order > 0).groupBy("stub").agg(F.min_by(F.struct("ext", "size", "path"), order).alias("f"))
    joined = works.drop("file_ext", "file_size", "file_path", "file_exists", "owned").join(best, works["file_stub"] == best["stub"], "left").drop("stub")
    has = F.col("f").isNotNull().cast("int")
    return joined.withColumns({"file_ext": F.col("f.ext"), "file_size": F.col("f.size"), "file_path": F.col("f.path"), "file_exists": has, "owned": has}).drop("f")


def library_sorted(df: DataFrame, *columns: tuple[str, bool]) -> DataFrame:
    """(column, ascending) pairs; nulls count as the least value."""
    return df.orderBy(*[F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in columns])
