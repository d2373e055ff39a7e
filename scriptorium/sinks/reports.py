"""Sinks: semicolon CSV, graph exchange XML, graph JSON, HTML tables, session folders, Markdown.

Files for people are rendered on the driver from reports of a stated number of rows; tables are written
by the executors.
"""

from __future__ import annotations

import html
import json
import re
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a file for people may have.
REPORT_ROWS = 50_000
#: Columns of a table of similarities.
TABLE_COLUMNS = 1_000


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def session_key(names: DataFrame, column: str) -> DataFrame:
    """The first eight digits of the SHA-1 of the sorted base names."""
    base = F.regexp_extract(column, r"[^/\\]+$", 0)
    return names.agg(F.substring(F.sha1(F.array_join(F.sort_array(F.collect_list(base)), "|").cast("binary")), 1, 8).alias("session_key"))


def _bounded(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows; write a table instead")
    return rows


def gexf(nodes: DataFrame, edges: DataFrame, *, directed: bool = True) -> str:
    """Graph exchange XML of nodes (id, label) and edges (u, v, weight)."""
    own = "\n".join(f"      <node id={quoteattr(str(r['id']))} label={quoteattr(str(r['label']))}/>" for r in _bounded(nodes.select("id", "label").orderBy("id")))
    ties = "\n".join(f'      <edge id="{i}" source={quoteattr(str(r["u"]))} target={quoteattr(str(r["v"]))} weight="{float(r["weight"])}"/>' for i, r in enumerate(_bounded(edges.select("u", "v", "weight").orderBy("u", "v"))))
    kind = "directed" if directed else "undirected"
    return f'<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n  <graph defaultedgetype="{kind}" mode="static">\n    <nodes>\n{own}\n    </nodes>\n    <edges>\n{ties}\n    </edges>\n  </graph>\n</gexf>\n'


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    return json.dumps({"nodes": [json.loads(r["j"]) for r in _bounded(nodes.select(F.to_json(F.struct("*")).alias("j")))], "edges": [json.loads(r["j"]) for r in _bounded(edges.select(F.to_json(F.struct("*")).alias("j")))]}, ensure_ascii=False)


def html_table(df: DataFrame) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in _bounded(df))
    return f"<table>\n<tr>{head}</tr>\n{body}\n</table>"


def filled_template(template: str, parts: dict[str, str]) -> str:
    """The template with each {{name}} replaced by its part. Parts aren't searched for names themselves; names without a part are an error."""

    def part(m: re.Match) -> str:
        if m[1] not in parts:
            raise ValueError(f"no part for {m[0]}")
        return parts[m[1]]

    return re.sub(r"\{\{(\w+)\}\}", part, template)


def marked_once(text: str, start: int, end: int) -> str:
    return f"{html.escape(text[:start])}<mark>{html.escape(text[start:end])}</mark>{html.escape(text[end:])}"


def similarity_table(pairs: DataFrame) -> DataFrame:
    """The pairs as a square of rows and columns, in order. More than TABLE_COLUMNS names are an error: write the pairs, or the nearest of each, instead."""
    both = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    names = [r["a"] for r in both.select("a").distinct().orderBy("a").limit(TABLE_COLUMNS + 1).collect()]
    if len(names) > TABLE_COLUMNS:
        raise ValueError(f"a table of more than {TABLE_COLUMNS} columns")
    return both.groupBy("a").pivot("b", names).agg(F.first("similarity")).na.fill(0.0).orderBy("a")


def write_mentions(hits: DataFrame, summary: DataFrame, folder: str) -> None:
    """hits by document, page and place, and the summary by weight, each as one sorted CSV with semicolons; for results of the size that people read.

    Columns that a table lacks are left out of its order; equal rows stand in the order of all columns.
    """
    sorts = (("mentions", hits, ("grp", "label", "doc_id", "page", "start"), ()), ("summary", summary, ("grp", "label"), ("weighted", "mentions")))
    for name, df, up, down in sorts:
        first = [F.desc(c) for c in down if c in df.columns] + [F.asc(c) for c in up if c in df.columns]
        write_csv(df.orderBy(*first, *df.columns), f"{folder}/{name}", one_file=True)


def markdown(paragraphs: DataFrame, order: str, text: str) -> str:
    return "\n\n".join(r[text] for r in _bounded(paragraphs.orderBy(order))) + "\n"
