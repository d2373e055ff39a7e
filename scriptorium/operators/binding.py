"""Binding files, mentions and authors to each other: bibliography to authors and works, author mentions, virtual documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.canons import name_in_parentheses

#: Rows of a canon, which people write, up to which it is broadcast.
CANON_ROWS = 100_000
#: Bytes of a canon's patterns that every task may hold.
CANON_BYTES = 32 << 20
_MENTION = "tgt string, start int, end int, pattern string, context string"


def canon(df: DataFrame) -> DataFrame:
    """df, broadcast if it is as small as canons are."""
    return F.broadcast(df) if df.limit(CANON_ROWS + 1).count() <= CANON_ROWS else df


def author_mentions(pages: DataFrame, targets: DataFrame, *keep: str) -> DataFrame:
    """keep columns, tgt, start, end, pattern, context: where targets (author_id, surnames folded, patterns, negatives) are named in pages (text).

    A page meets a target only if a folded surname stands in it. A target's patterns are tried in order and a
    span counts once; a span whose context one of the negatives matches doesn't count. Patterns that don't
    compile are left out. Targets are a list that people write, CANON_ROWS rows and CANON_BYTES at most (more are an error): every
    task holds them, and each page goes to Python once, where one pass finds the targets it may name.
    """
    size = F.octet_length(F.to_json(F.struct("author_id", "surnames", "patterns", "negatives")))
    known = targets.limit(CANON_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    if known["n"] > CANON_ROWS or known["bytes"] > CANON_BYTES:
        raise ValueError(f"more than {CANON_ROWS} targets or {CANON_BYTES} bytes of patterns")
    listed = [(r["author_id"], list(r["surnames"] or ()), list(r["patterns"] or ()), list(r["negatives"] or ())) for r in targets.select("author_id", "surnames", "patterns", "negatives").collect()]
    shared = pages.sparkSession.sparkContext.broadcast(listed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        own_targets = [(tgt, surnames, [re.compile(p, re.IGNORECASE) for p in P.usable(patterns)], [re.compile(p, re.IGNORECASE) for p in P.usable(negatives)]) for tgt, surnames, patterns, negatives in shared.value]
        named: dict[str, list[int]] = {}
        for i, (_, surnames, _, _) in enumerate(own_targets):
            for s in surnames:
                if s is not None:
                    named.setdefault(s, []).append(i)
        anywhere = named.pop("", [])
        automaton = ahocorasick.Automaton()
        for surname, own in named.items():
            automaton.add_word(surname, own)
        if named:
            automaton.make_automaton()
        for pdf in frames:
            rows = []
            for own, text, folded in zip(pdf[list(keep)].itertuples(index=False), pdf["text"], pdf["_folded"], strict=True):
                if not text:
                    continue
                held = set(anywhere)
                for _, some in automaton.iter(folded) if named else ():
                    held.update(some)
                for tgt, _, patterns, negatives in map(own_targets.__getitem__, sorted(held)):
                    seen = set()
                    for p in patterns:
                        for m in p.finditer(text):
                            if m.span() in seen:
                                continue
                            seen.add(m.span())
                            lo = max(0, (m.start() + m.end()) // 2 - 70)
                            context = " ".join(text[lo : lo + 140].split())
                            if not any(n.search(context) for n in negatives):
                                rows.append((*own, tgt, m.start(), m.end(), p.pattern, context))
            yield pd.DataFrame(rows, columns=[*keep, "tgt", "start", "end", "pattern", "context"])

    return pages.select(*keep, "text", T.casefold(T.fold(F.col("text"))).alias("_folded")).mapInPandas(run, f"{schema}, {_MENTION}")


def _best_token_overlap(files: DataFrame, file: str, entities: DataFrame, name: Column, least: int = 1) -> DataFrame:
    """file, ordinal of the entity with most words in common, the first of equally good ones."""
    a = files.select(file, F.explode(T.token_set(F.col("name"), least=1)).alias("token"))
    b = entities.select("ordinal", F.explode(T.token_set(name, least=1)).alias("token"))
    shared = a.join(canon(b), "token").groupBy(file, "ordinal").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return shared.groupBy(file).agg(F.min_by("ordinal", F.struct(-F.col("n"), "ordinal")).alias("ordinal"))


def bibliography_authors(files: DataFrame, file: str, authors: DataFrame) -> DataFrame:
    """file, author_id, step: authors (ordinal, author_id, display, filename_aliases, merge_into) of files (file, name).

    The author displayed as the name in parentheses (step 0); else all one of whose file name patterns
    matches, after merge_into (1); else the one with most words in common, after merge_into (2). A merged
    author that isn't in the list is none. Files that nothing matches have no row.
    """
    own = authors.withColumn("target", F.coalesce("merge_into", "author_id"))
    displayed = authors.select(T.normalize(F.col("display")).alias("_key"), "author_id").groupBy("_key").agg(F.max_by("author_id", "author_id").alias("author_id"))
    first = files.select(file, name_in_parentheses(F.col("name")).alias("_key")).join(canon(displayed), "_key").select(file, "author_id", F.lit(0).alias("step"))
    known = own.select(F.col("author_id").alias("target")).distinct()
    aliases = own.join(known, "target", "left_semi").select("target", F.explode("filename_aliases").alias("alias"))
    second = files.join(canon(aliases), F.expr("name RLIKE concat('(?iU)', alias)")).select(file, F.col("target").alias("author_id"), F.lit(1).alias("step")).distinct()
    words = F.concat_ws(" ", "display", F.replace(F.col("author_id"), F.lit("-"), F.lit(" ")))
    third = _best_token_overlap(files, file, own, words).join(canon(own.join(known, "target", "left_semi").select("ordinal", "target")), "ordinal").select(file, F.col("target").alias("author_id"), F.lit(2).alias("step"))
    every = first.union(second).union(third)
    least = every.groupBy(file).agg(F.min("step").alias("step"))
    return every.join(least, [file, "step"]).select(file, "author_id", "step")


def bibliography_works(files: DataFrame, file: str, works: DataFrame) -> DataFrame:
    """file, canonical, step: works (ordinal, canonical, aliases, negatives) with an alias and no negative that matches (0); else the one with most words in common (1)."""
    some = lambda c: f"exists({c}, p -> name RLIKE concat('(?iU)', p))"
    first = files.join(canon(works.select("canonical", "aliases", "negatives")), F.expr(f"{some('aliases')} AND NOT {some('negatives')}")).select(file, "canonical", F.lit(0).alias("step"))
    rest = files.join(first.select(file).distinct(), file, "left_anti")
    second = _best_token_overlap(rest, file, works, F.translate("canonical", "_", " ")).join(canon(works.select("ordinal", "canonical")), "ordinal").select(file, "canonical", F.lit(1).alias("step"))
    return first.union(second)


def virtual_author_edges(mentions: DataFrame, src: str, tgt: str) -> DataFrame:
    """from_doc, to_doc (a document that stands for the cited author), weight, raw_source."""
    return mentions.groupBy(F.col(src).alias("from_doc"), F.concat(F.lit("VIRT_AUTHOR_"), F.col(tgt), F.lit(".pdf")).alias("to_doc")).agg(F.count("*").cast("double").alias("weight")).withColumn("raw_source", F.lit("authors_search"))


def sampled_edges(hits: DataFrame, src: str, tgt: str, page: str, context: str, order: list[str], samples: int = 5, width: int = 240) -> DataFrame:
    """src, tgt, weight, samples: the first contexts of each edge as `p<page>: <context>`. Each task passes on its first ones only."""
    nth = F.row_number().over(Window.partitionBy(src, tgt).orderBy(*order))
    sample = F.concat(F.lit("p"), F.col(page), F.lit(": "), F.left(F.col(context), F.lit(width)))
    first = hits.select(src, tgt, *order, sample.alias("_sample")).withColumn("_nth", nth).where(F.col("_nth") <= samples)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "_sample"))), lambda s: s["_sample"]), " || ")
    return hits.groupBy(src, tgt).agg(F.count("*").alias("weight")).join(first.groupBy(src, tgt).agg(joined.alias("samples")), [src, tgt])


def base_author(pseudo: DataFrame, authors: DataFrame) -> DataFrame:
    """pseudo's author_id and base_id: the author displayed as the name in parentheses of its display, else of its id."""
    own = pseudo.select("author_id", F.coalesce(name_in_parentheses(F.col("display")), F.lit("")).alias("_a"), F.coalesce(name_in_parentheses(F.col("author_id")), F.lit("")).alias("_b"))
    by = authors.select(T.normalize(F.col("display")).alias("_key"), F.col("author_id").alias("base")).where("_key != ''").groupBy("_key").agg(F.min("base").alias("base"))
    of = lambda k: own.join(canon(by), F.col(k) == F.col("_key")).select("author_id", F.col("base").alias("base_id"), F.lit(k).alias("_step"))
    return of("_a").union(of("_b")).groupBy("author_id").agg(F.min_by("base_id", "_step").alias("base_id"))


def original_links(texts: DataFrame, key: str, name: str, files: DataFrame, file: str, path: str) -> DataFrame:
    """key and file: the first file (by id) of the same normalised base name without ending."""
    base = lambda c: T.normalize(F.regexp_replace(T.basename(F.col(c)), r"\.[^.]+$", ""))
    first = files.select(base(path).alias("_base"), file).where("_base != ''").groupBy("_base").agg(F.min(file).alias("original"))
    return texts.select(key, base(name).alias("_base")).join(first, "_base").select(key, "original")


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the values of changes (one row for a key) where they aren't null."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def filtered_edges(edges: DataFrame, term: str = "", *, only_text: bool = False, only_bib: bool = False) -> DataFrame:
    """Edges (src, tgt, examples, text_hits, bib_hits) whose names or examples hold the term, any case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(F.col("src").cast("string"), F.lit("")), F.coalesce(F.col("tgt").cast("string"), F.lit("")), F.coalesce("examples", F.lit(""))))
    out = edges.where(F.contains(hay, F.lit(term.lower()))) if term else edges
    out = out.where("text_hits > 0") if only_text else out
    return out.where("bib_hits > 0") if only_bib else out


def from_source_file(path: Column, *, texts_too: bool = False) -> Column:
    """If the file is a chronicle's by its name: `chr_` or `chr-` first; with texts_too, `chr_` or the ending .txt."""
    name = F.lower(T.basename(path))
    return (name.startswith("chr_") | name.endswith(".txt")) if texts_too else (name.startswith("chr_") | name.startswith("chr-"))


def in_groups(hits: DataFrame, *, series: bool = False) -> DataFrame:
    return hits.where(F.col("grp").isin("work", "series") if series else F.col("grp") == "work")


def has_text_layer(pages: DataFrame, doc: str, page: str, text: str, *, first: int = 5, least: int = 40) -> DataFrame:
    """doc, has_text: if its first pages hold more than `least` characters, blanks at their ends not counted."""
    n = F.sum(F.when(F.col(page) <= first, F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))).otherwise(0))
    return pages.groupBy(doc).agg((n > least).alias("has_text"))


def found_sections(detectors: list[DataFrame], doc: str) -> DataFrame:
    """Of detectors' pages (doc, first, last) in order of trust, each document's first, with the number of its detector."""
    every = None
    for i, d in enumerate(detectors):
        own = d.select(doc, "first", "last", F.lit(i).alias("detector"))
        every = own if every is None else every.union(own)
    best = F.min_by(F.struct("first", "last", "detector"), F.struct("detector", "first", "last"))
    return every.groupBy(doc).agg(best.alias("b")).select(doc, "b.*")


def searched_labels(nodes: DataFrame, label: str, term: str, *, exact: bool = False) -> DataFrame:
    """Nodes whose label is the term, or holds it in any case."""
    return nodes.where(F.col(label) == term) if exact else nodes.where(F.contains(F.lower(label), F.lit(term.lower())))


def focused(edges: DataFrame, node, *, cited: bool) -> DataFrame:
    """The edges into a node, or out of it."""
    return edges.where(F.col("tgt" if cited else "src") == node)


def injected(terms: Column, seed: Column) -> Column:
    """The seed put first unless a term equals it in any case."""
    here = F.exists(terms, lambda x: T.casefold(x) == T.casefold(seed))
    return F.when(here, terms).otherwise(F.concat(F.array(seed), terms))


def locale_order(c: Column, locale: str = "de", *ties: Column) -> list[Column]:
    """A total order as readers of a language sort: by its collation (letters before marks before case), then by the characters, then by `ties`."""
    return [F.collate(c, locale), F.collate(c, "UTF8_BINARY"), *ties]


def session_meta(session: str, created: str, files: list[str], settings: dict) -> str:
    """The JSON that lies beside a session's results."""
    import json

    return json.dumps({"session": session, "created_at": created, "files": sorted(files), "n_files": len(files), "settings": settings}, ensure_ascii=False, indent=2, sort_keys=True)
