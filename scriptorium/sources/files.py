"""Sources: document folders, sanitised CSV, canons, manifests, web pages."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sinks import versions
from . import records as R

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("pdf", "txt"), *, recursive: bool = True, without_folder: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of files by extension, any case; folders of a name are left out."""
    ext = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{ext}}}").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.where(~F.lower("path").rlike(f"/{without_folder.lower()}/")) if without_folder else files


def text_pages(files: DataFrame) -> DataFrame:
    """path, page (1), text of text files, invalid UTF-8 replaced."""
    return files.select("path", F.lit(1).alias("page"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def extracted_pages(files: DataFrame, extract) -> DataFrame:
    """path, page, text by a function from bytes to a list of page texts, in bounded batches; a failing file has no page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i + 1, t) for i, t in enumerate(extract(content))]
                except (ValueError, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def page_key(path: Column, mtime: Column, page: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, mtime.cast("long"), page))


def cached_pages(spark: SparkSession, folder: str, files: DataFrame, extract) -> DataFrame:
    """path, modificationTime, page, key, text of files (path, modificationTime, content), from the cache in a folder; what it lacks is extracted and added to it.

    A file is in the cache if its path is, with the same time to the second. Nothing that is there is read again or written again; pages of
    earlier times stay in the cache, and rebuilding it from current files drops them. Files that fail have no page and are tried again.
    """
    now = versions.version(folder)
    own = files.withColumn("_time", F.col("modificationTime").cast("long"))
    fresh = own if now is None else own.join(versions.read(spark, folder).select("path", F.col("modificationTime").cast("long").alias("_time")).distinct(), ["path", "_time"], "left_anti")
    pages = extracted_pages(fresh, extract).join(fresh.select("path", "modificationTime"), "path")
    rows = pages.select("path", "modificationTime", "page", page_key(F.col("path"), F.col("modificationTime"), F.col("page")).alias("key"), "text")
    if fresh.limit(1).count():
        versions.changed(spark, folder, lambda _: rows, further=True)
    if versions.version(folder) is None:
        return rows.limit(0)
    return versions.read(spark, folder).withColumn("_time", F.col("modificationTime").cast("long")).join(own.select("path", "_time"), ["path", "_time"], "left_semi").drop("_time")


def chosen_text(text: Column, ocr: Column, least: int = 120) -> Column:
    """The text layer if long enough, else the longer of it and the scan's."""
    return F.when(F.length(F.trim(text)) >= least, text).when(F.length(ocr) > F.length(text), ocr).otherwise(F.coalesce(F.nullif(text, F.lit("")), ocr))


def identifiers(header: list[str]) -> list[str]:
    """SQL names for CSV headings; equal ones are an error."""
    import unicodedata

    out = []
    for name in header:
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
        out.append(re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or "col")
    if len(set(out)) < len(out):
        raise ValueError(f"equal headings: {sorted({x for x in out if out.count(x) > 1})}")
    return out


def _headed(spark: SparkSession, path: str, delimiter: str, header: list[str], notes: str | None, plain: bool, split: int) -> DataFrame:
    names = identifiers(header)
    extra = names.index(notes) if notes in names else len(names) - 1

    def shape(row: list[str]) -> list[str]:
        own, over = [*row[: len(names)], *[""] * (len(names) - len(row))], row[len(names) :]
        if over and notes is not None:
            own[extra] += " | EXTRA: " + " | ".join(c.strip() for c in over if c.strip())
        return [c.strip() for c in own]

    return R.records(spark, path, delimiter, len(names), plain=plain, split=split, shape=shape, names=names)


def _heading(text: str, delimiter: str) -> list[str]:
    return [h.strip() for h in next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), [])]


def sanitized_csv(spark: SparkSession, path: str, *, notes: str = "notizen", delimiter: str | None = None, split: int = R.SPLIT) -> DataFrame:
    """A CSV as text columns: plain quotes, no BOM, fields beyond the heading added to the notes column (or the last), short rows padded, all trimmed.

    Quoted fields may hold line breaks; files are read in splits. The delimiter is guessed from the head. A null cell is an empty one; empty
    lines are left out. An empty file, and two equal headings, are errors.
    """
    text = R.plain_quotes(R.head(path))
    if not text.strip():
        raise ValueError(f"{path} is empty")
    mark = delimiter or R.sniffed_delimiter(text)
    return _headed(spark, path, mark, _heading(text, mark), notes, True, split)


def browser_csv(spark: SparkSession, path: str, *, split: int = R.SPLIT) -> DataFrame:
    """A CSV as the report pages read it: comma, or semicolon if the first five lines have more of them; typographic quotes stay, further fields are dropped. An empty file has no column."""
    text = R.head(path)
    mark = R.browser_delimiter(text)
    header = _heading(text, mark)
    return _headed(spark, path, mark, header, None, False, split) if header else spark.createDataFrame([], "")


def mentions_csv(spark: SparkSession, path: str, needed: tuple[str, ...] = (), *, split: int = R.SPLIT) -> DataFrame:
    """A table of mentions by semicolon, else comma, else the guessed mark: the first that gives several columns, or all that are needed. A file without rows is an error."""
    text = R.head(path)
    found = None
    for mark in (";", ",", R.sniffed_delimiter(text)):
        header = _heading(text, mark)
        if set(needed) <= set(header) if needed else len(header) > 1:
            found = mark
            break
    df = _headed(spark, path, found or ";", _heading(text, found or ";"), None, False, split) if text.strip() and (found or not needed) else None
    if df is None or not df.limit(1).count():
        raise ValueError(f"{path} is empty or has no columns {needed}")
    return df


def guessed_column(df: DataFrame, candidates: tuple[str, ...]) -> str:
    """The first candidate that is a column, any case."""
    own = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in own:
            return own[c.lower()]
    raise ValueError(f"none of {candidates} among {df.columns}")


def chronicle_canon(spark: SparkSession, path: str) -> DataFrame:
    """kind, label, patterns, weight of works, series and generic terms of one JSON file."""
    raw = spark.read.option("multiLine", True).schema("works array<struct<canonical: string, aliases: array<string>>>, series array<struct<canonical: string, aliases: array<string>>>, generic_terms array<struct<label: string, patterns: array<string>>>, weights map<string, double>").json(path)
    kinds = [raw.select(F.lit(kind).alias("kind"), F.explode(column).alias("e"), "weights").select("kind", F.col(f"e.{name}").alias("label"), F.col(f"e.{patterns}").alias("patterns"), F.coalesce(F.try_element_at("weights", F.lit(kind)), F.lit(1.0)).alias("weight")) for kind, column, name, patterns in (("work", "works", "canonical", "aliases"), ("series", "series", "canonical", "aliases"), ("generic", "generic_terms", "label", "patterns"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))


def page_variables(html: Column) -> dict[str, Column]:
    """Variables that a viewer's page sets, and the pictures it lists, each once, in order."""
    one = lambda name: F.nullif(F.regexp_extract(html, rf"window\.epdata\.{name}\s*=\s*'([^']+)'", 1), F.lit(""))
    block = F.regexp_extract(html, r"(?is)pagesMinified\s*=\s*\[(.*?)\]\s*;", 1)
    listed = F.regexp_extract_all(block, F.lit(r"\[\s*'([^']+?\.jpg)'\s*,"), F.lit(1))
    anywhere = F.regexp_extract_all(html, F.lit(r"'([^']+?\.jpg)'"), F.lit(1))
    return {"system": one("iiifSystemId"), "endpoint": one("iiifEndpointUri"), "manifest": one("iiifManifestUri"), "presentation": one("iiifPresentationBaseUrl"), "pid": one("docPid"), "pages": F.array_distinct(F.when(block != "", listed).otherwise(anywhere))}


def page_title(html: Column, otherwise: str = "E-Periodica Dokument") -> Column:
    """og:title, else the first h1 or h2, else the title, else a constant."""
    part = lambda regex: F.nullif(T.strip_html(F.regexp_extract(html, regex, 1)), F.lit(""))
    return F.coalesce(part(r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']"), part(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), part(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(otherwise))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1)))


def _label(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        value = value.get("@value") or next(iter(value.values()), "")
    if isinstance(value, list):
        return " ".join(filter(None, map(_label, value)))
    return value if isinstance(value, str) else ""


def manifest_chapters(manifests: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, ordinal, label, first, last: leaf ranges of version 2 and 3 manifests as page spans, from the least to the greatest page named."""

    def leaves(node: dict, v3: bool) -> Iterator[tuple[str, list[str]]]:
        for key in ("ranges", "items") if v3 else ("ranges",):
            for child in node.get(key) or []:
                if isinstance(child, dict) and (key == "ranges" or child.get("items") is not None or child.get("type") == "Range"):
                    yield from leaves(child, v3)
        own = [c.get("id") for c in node.get("items") or [] if isinstance(c, dict) and c.get("type") != "Range"] if v3 else [c for c in node.get("canvases") or [] if isinstance(c, str)]
        if own:
            yield _label(node.get("label")), own

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for own, text in zip(pdf[id_col], pdf[json_col], strict=True):
                try:
                    m = json.loads(text or "")
                except ValueError:
                    continue
                v3 = isinstance(m.get("items"), list)
                canvases = [c.get("id") for c in m["items"]] if v3 else [c.get("@id") for c in (m.get("sequences") or [{}])[0].get("canvases") or []]
                place = {c: i + 1 for i, c in enumerate(canvases)}
                for top in m.get("structures") or []:
                    for label, named in leaves(top, v3):
                        at = [place[c] for c in named if c in place]
                        if at:
                            rows.append((own, len([r for r in rows if r[0] == own]), label, min(at), max(at)))
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "label", "first", "last"])

    kind = manifests.schema[id_col].dataType.simpleString()
    return manifests.select(id_col, json_col).mapInPandas(run, f"{id_col} {kind}, ordinal int, label string, first int, last int")


def chapter_title(label: Column) -> tuple[Column, Column]:
    """Title and authors of `author – title`, `title / author` or `author: title`, where the lengths fit."""
    part = lambda regex, g: F.trim(F.regexp_extract(label, regex, g))
    dash, slash, colon = r"^\s*(.+?)\s*[–—]\s*(.+?)\s*$", r"^\s*(.+?)\s*/\s*(.+?)\s*$", r"^\s*(.+?)\s*:\s*(.+?)\s*$"
    longer = lambda regex: label.rlike(regex) & (F.length(part(regex, 2)) >= F.length(part(regex, 1)))
    title = F.when(longer(dash), part(dash, 2)).when(label.rlike(slash), part(slash, 1)).when(longer(colon), part(colon, 2)).otherwise(label)
    author = F.when(longer(dash), part(dash, 1)).when(label.rlike(slash), part(slash, 2)).when(longer(colon), part(colon, 1)).otherwise("")
    return title, T.split_authors(author, r";| und | and |&")


def json_object(text: Column, schema: str) -> Column:
    """The outermost braces of a tolerant JSON answer, code fences and talk around them dropped."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
