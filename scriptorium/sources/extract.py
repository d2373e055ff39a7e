"""Page texts by the best of several extractors, and the text of DOCX files with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import written
from .files import extracted_pages

#: Letters of a page that is long enough to be judged.
LEAST = 40
#: Letters of a DOCX file's text after which a further page begins, at a paragraph.
DOCX_PAGE = 1 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def docx_pages(content: bytes, most: int = DOCX_PAGE) -> list[str]:
    """The paragraphs of a document's body, one on each line, without those of tables; in pages of about `most` letters. What is no DOCX is a ValueError."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
            pages: list[str] = []
            held, size, path = [], 0, []
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    path.append(node.tag)
                    continue
                path.pop()
                if node.tag == f"{_W}p" and path and path[-1] == f"{_W}body":
                    own = "".join(_MARKS[x.tag] if x.tag in _MARKS else x.text or "" for x in node.iter() if x.tag in _MARKS or x.tag == f"{_W}t")
                    if held and size + len(own) > most:
                        pages.append("\n".join(held))
                        held, size = [], 0
                    held.append(own)
                    size += len(own) + 1
                if path and path[-1] == f"{_W}body":
                    node.clear()
            return [*pages, "\n".join(held)] if held or not pages else pages
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError) as e:
        raise ValueError(f"no DOCX: {e}") from e


def best_pages(files: DataFrame, extractors: list[tuple[Callable[[bytes], list[str]], float]], *, least: int = LEAST) -> DataFrame:
    """path, page, text, extractor of files (path, content) by a cascade of extractors, each a function from bytes to page texts and a bar.

    A page is settled by the first extractor after which its longest text so far (of equal ones the earlier) has `least` letters and a
    quality of that extractor's bar; where none settles it, the longest text is taken. An extractor only sees files with a page
    that isn't settled, or without pages so far. Files on which all fail have no page. extractor is the number of the one whose text it is.
    """
    best = None
    for i, (extract, bar) in enumerate(extractors):
        todo = files
        if best is not None:
            done = best.groupBy("path").agg(F.bool_and("settled").alias("all")).where("all")
            todo = files.join(done.select("path"), "path", "left_anti")
        now = extracted_pages(todo, extract).select("path", "page", F.coalesce("text", F.lit("")).alias("_new"))
        old = best if best is not None else now.limit(0).select("path", "page", F.col("_new").alias("text"), F.lit(-1).alias("extractor"), F.lit(False).alias("settled"))
        both = old.join(now, ["path", "page"], "full")
        longer = ~F.coalesce("settled", F.lit(False)) & F.col("_new").isNotNull() & (F.col("text").isNull() | (F.length("_new") > F.length("text")))
        text = F.when(longer, F.col("_new")).otherwise(F.col("text"))
        chosen = both.select("path", "page", text.alias("text"), F.when(longer, i).otherwise(F.col("extractor")).alias("extractor"), F.coalesce("settled", F.lit(False)).alias("settled"))
        good = (F.length("text") >= least) & (T.quality_score(F.col("text")) >= bar)
        best = written(chosen.withColumn("settled", F.col("settled") | F.coalesce(good, F.lit(False))), "pages")
    return best.drop("settled") if best is not None else files.select("path", F.lit(1).alias("page"), F.lit("").alias("text"), F.lit(0).alias("extractor")).limit(0)
