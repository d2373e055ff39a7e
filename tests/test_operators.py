"""Operators that SQL can't express, against plain Python on small fixtures."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import patterns
from scriptorium.functions import text as T
from scriptorium.operators import binding, catalog, citations, cleaning, edges, keywords, mentions, network, report, resolve, sections
from scriptorium.sinks import reports
from scriptorium.sources import canons, files
from scriptorium.streaming import mentions as stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_fold_is_full_decomposition_on_latin_letters(spark):
    alphabet = "".join(chr(c) for c in range(0x20, 0x250)) + "ſßæœ漢"
    df = spark.createDataFrame([(alphabet,)], "t string")
    row = df.select(T.fold(F.col("t")).alias("a"), T.nfkd_fold("t").alias("b")).first()
    bases = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in alphabet]
    assert row["a"] == "".join(b if len(b) == 1 else c for c, b in zip(alphabet, bases, strict=True)) and row["b"] == "".join(bases)
    assert one(spark, T.fold(F.col("t")), t="Éàüñ çØ ǆ") == "Eaun cØ ǆ"


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.normalize, "  Über  die\nSchweiz ", "uber die schweiz"),
        (T.canonical_key, "Die Berner Chronik, Bd. 2", "die bd 2"),
        (T.slugify, "Müller, Hans!", "muller-hans"),
        (T.slugify, "!!!", "anon"),
        (T.normalize_finder, "Ver-\nfaſſer  Straße ﬁn", "Verfasser Strasse fin"),
        (T.normalize_term, "Jvbel Süß", "iubel suess"),
        (T.normalize_mhd, "Vnd Jar ſyn ß", "und iar sin ss"),
        (T.normalize_report, "Vnd, jüng!", "vnd ivng"),
        (T.modernize_letters, "vnd ſo auff", "und so auf"),
        (T.basename, "/a/b\\c.pdf", "c.pdf"),
        (T.strip_html, "<p>a<br>b</p>", "a b"),
        (lambda c: T.primary_token(T.slugify(c, None)), "Müller von der Chronik III", "muller"),
        (lambda c: T.modernize_words(c, {"vnd": "und"}), "Vnd VND vnd, xvnd", "Und UND und, xvnd"),
        (lambda c: citations.markup(F.lit("K1"), c), "vgl. 35–36", " [vgl. @K1, pp. 35–36]"),
        (lambda c: citations.markup(F.lit("K1"), c), "", " [@K1]"),
        (lambda c: citations.markup(F.lit("K1"), c), "passim", " [passim @K1]"),
        (lambda c: files.chapter_title(c)[0], "Meyer – Die lange Geschichte", "Die lange Geschichte"),
        (lambda c: files.page_title(c), '<title>x</title><h1>A <b>b</b></h1><meta property="og:title" content="OG">', "OG"),
        (lambda c: files.chosen_text(c, F.lit("longer text")), "short", "longer text"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, f(F.col("t")), t=given) == want


def test_spans_are_those_of_python(spark):
    docs = spark.createDataFrame([(1, "Über über UBER vnd vndt"), (2, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["ordinal"], r["start"], r["end"]) for r in mentions.find_spans(docs, [r"\büber\b", "(", r"vnd\w*", r"vnd\b"], "doc_id").orderBy("start", "ordinal").collect()]
    assert got == [(1, 0, 0, 4), (1, 0, 5, 9), (1, 2, 15, 18), (1, 2, 19, 23)]
    patterns = spark.createDataFrame([("u", "work", r"\büber\b")], "label string, grp string, regex string")
    assert mentions.regex_mentions(docs, patterns).first()["cnt"] == 2


def test_a_text_of_many_matches_goes_through_python_once(spark):
    docs = spark.range(1).select("id", F.repeat(F.lit("und " + "x" * 40 + " "), 9000).alias("text"))
    found = mentions.find_spans(docs, [r"\bund\b"], "id", "text").agg(F.count("*"), F.max("start"), F.min(F.length("text"))).first()
    assert tuple(found) == (9000, 8999 * 45, 9000 * 45)


def test_greedy_pairs_are_those_of_one_by_one(spark):
    rows = [(i, j, float((i * 7 + j * 13) % 11)) for i in range(6) for j in range(5)]
    want, left, right = set(), set(), set()
    for i, j, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if i not in left and j not in right:
            want.add((i, j))
            left.add(i)
            right.add(j)
    got = resolve.greedy_one_to_one(spark.createDataFrame(rows, "k int, e int, score double"), "k", "e")
    assert {(r["k"], r["e"]) for r in got.collect()} == want


def test_one_edit(spark):
    pairs = [("abc", "acb", True), ("abc", "abd", True), ("abc", "abcd", True), ("abc", "ab", True), ("abc", "abc", True), ("abc", "cab", False), ("abc", "axyc", False), ("a", None, False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(resolve.within_one_edit("a", "b") != F.col("want")).count() == 0


def test_thinning_keeps_edges_until_both_ends_are_full(spark):
    rows = [("hub", f"n{i}", 100 - i) for i in range(20)] + [("n0", "n1", 1)]
    got = network.thinned(spark.createDataFrame(rows, "u string, v string, weight int"), most=10, per_node=3)
    assert got.count() == 10


def test_clean_edition(spark):
    raw = "12\nBASLER CHRONIKEN\nItem do kam der hertzog [Anm.] in die ver-\nlorne burg 1)\n\nDer Herausgeber sagt nichts.\n\nAnno 1415 ward (Vgl. dort) ein fehde , die endet"
    got = one(spark, cleaning.clean_edition(F.col("t")), t=raw)
    assert got == "Item do kam der hertzog in die verlorne burg\nAnno 1 ward ein fehde, die endet"  # as in the original, empty lines go and last digits of a year pass for a footnote mark
    assert one(spark, cleaning.clean_print(F.col("t")), t="Regiſter\na b\n-- 3 / 70 --\nVnd es\nwas\nB\n<36630565100015>") == "und es was"


def test_sections(spark):
    pages = spark.createDataFrame([("a", i, i in (2, 3, 5, 6, 7)) for i in range(1, 9)], "d string, p int, hit boolean")
    assert tuple(sections.longest_run(pages.where("hit"), "d", "p").first()) == ("a", 5, 7, 3)
    assert [r["in_bib"] for r in sections.to_the_end(pages, "d", "p", F.col("hit")).orderBy("p").collect()] == [0] + [1] * 7
    assert one(spark, sections.heading(F.col("t")).cast("string"), t="x\n  Quellen und Literatur \ny") == "true"
    toc = spark.createDataFrame([("a", 1, "Intro", 1), ("a", 2, "Bibliography", 90)], "d string, o int, t string, p int")
    assert tuple(sections.last_toc_entry(toc, "d", "o", "t", "p").first()) == ("a", 90, None)


def test_keywords_and_query_language():
    assert keywords.variants("Bund") == ["Bund", "Bunde", "Bunden", "Bunder", "Bundes"]
    assert re.fullmatch(keywords.historic_literal("junker"), "iuncer")
    assert re.search(keywords.family_regex(["a", "ab"]), "ab")[0] == "ab"
    assert report.parse('group:work label:"a b" frei') == [("group", "work"), ("label", "a b"), ("", "frei")]
    assert resolve.deduplicated_terms(["Frieden", "frieden", "Friedens", "Krieg"]) == ["Frieden", "Krieg"]


def test_dedupe_inherits_from_the_last_duplicate(spark):
    works = spark.createDataFrame([(1, "k", None), (2, "k", "f2"), (3, "k", "f3"), (4, "x", None)], "id int, key string, file string")
    child = spark.createDataFrame([(3,), (4,)], "work_id int")
    kept, moved = catalog.dedupe(works, {"c": child}, "key", inherit=("file",))
    assert sorted(map(tuple, kept.collect())) == [(1, "k", "f3"), (4, "x", None)]
    assert sorted(r["work_id"] for r in moved["c"].collect()) == [1, 4]


def test_families_point_from_cited_to_citing(spark):
    rows = spark.createDataFrame([("Meyer, Karl", "von Müller", "2,5"), ("meyer karl", "Müller", "x")], "src string, tgt string, w string")
    got = edges.author_families(rows, edges.numeric_weight(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [("muller", "karl", 3)]


def test_csv_and_canon_and_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Werk;Prägung;Notizen\r\n„A“; b ;n;x;y\r\nB\r\n", encoding="utf-8")
    got = files.sanitized_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["werk", "pragung", "notizen"]
    assert sorted(map(tuple, got.collect())) == [("A", "b", "n | EXTRA: x | y"), ("B", "", "")]
    with pytest.raises(ValueError):
        files.identifiers(["A", "a"])
    (tmp_path / "c.json").write_text(json.dumps({"works": [{"canonical": "W", "aliases": ["w"]}], "series": [], "generic_terms": [{"label": "g", "patterns": ["p"]}], "weights": {"work": 2.0}}))
    assert {tuple(r) for r in files.chronicle_canon(spark, str(tmp_path / "c.json")).select("kind", "label", "weight").collect()} == {("work", "W", 2.0), ("generic", "g", 1.0)}
    v2 = {"sequences": [{"canvases": [{"@id": f"c{i}"} for i in range(5)]}], "structures": [{"label": "top", "ranges": [{"label": "one", "canvases": ["c1", "c3"]}]}]}
    v3 = {"items": [{"id": "x"}, {"id": "y"}], "structures": [{"type": "Range", "label": {"de": ["L"]}, "items": [{"id": "y", "type": "Canvas"}]}]}
    df = spark.createDataFrame([(1, json.dumps(v2)), (2, json.dumps(v3)), (3, "no json")], "id int, j string")
    assert sorted(map(tuple, files.manifest_chapters(df, "id", "j").collect())) == [(1, 0, "one", 2, 4), (2, 0, "L", 2, 2)]


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "sub" / "Chroniken").mkdir(parents=True)
    (tmp_path / "sub" / "a.TXT").write_text("Grüezi")
    (tmp_path / "sub" / "Chroniken" / "b.txt").write_text("x")
    found = files.document_files(spark, str(tmp_path), without_folder="chroniken")
    assert [r["text"] for r in files.text_pages(found).collect()] == ["Grüezi"]
    pages = files.extracted_pages(found, lambda b: [b.decode()[:3], b.decode()[3:]])
    assert sorted((r["page"], r["text"]) for r in pages.collect()) == [(1, "Grü"), (2, "ezi")]
    nodes = spark.createDataFrame([("a&b", "A"), ("c", "C")], "id string, label string")
    ties = spark.createDataFrame([("a&b", "c", 2)], "u string, v string, weight int")
    assert 'source="a&amp;b" target="c" weight="2.0"' in reports.gexf(nodes, ties)
    assert json.loads(reports.graph_json(nodes, ties))["edges"] == [{"u": "a&b", "v": "c", "weight": 2}]
    assert "<td>a&amp;b</td>" in reports.html_table(nodes.limit(1).orderBy("id"))
    assert reports.marked_once("a<b", 1, 2) == "a<mark>&lt;</mark>b"
    reports.write_csv(nodes, f"file://{tmp_path}/out", one_file=True)
    assert spark.read.option("sep", ";").option("header", True).csv(f"file://{tmp_path}/out").count() == 2
    assert len(reports.session_key(nodes, "id").first()["session_key"]) == 8


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the and the" if i % 2 else "und") for i in range(20)], "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/in")
    canon = spark.createDataFrame([("the", "work", 1), ("und", "work", 1)], "label string, grp string, weight int")
    stream.mention_stream(stream.document_stream(spark, f"{tmp_path}/in", docs.schema, files_per_batch=1), canon, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["label"], r["mentions"], r["docs"]) for r in stream.label_totals(spark, f"{tmp_path}/out").collect()}
    assert got == {("the", 20, 10), ("und", 10, 10)}


def test_patterns(spark):
    p = patterns.surname_patterns("Müller-Meyer")
    assert re.search(p[0], "Müller Meyer, Karl") and re.search(p[1], "Karl Müller-Meyer") and re.search(p[2], "Müller-Meyer: Geschichte 1901")
    assert re.search(patterns.accents_allowed("Muller"), "Müller")
    assert re.fullmatch(patterns.flexible_blanks("a b"), "a -b")
    assert patterns.usable(["(", "a"]) == ["a"] and patterns.usable(["("], escape=True) == [r"\("]
    assert one(spark, patterns.filename_author(F.col("t")), t="Meyer, Karl - Buch.pdf") == "Meyer"
    assert one(spark, patterns.filename_author(F.col("t")), t="Karl Meyer_x.pdf") == "Karl Meyer"
    assert one(spark, patterns.filename_display(F.col("t"))[1], t="karl-h-meyer__12.pdf") == "Meyer, Karl"


def test_fuzzy_labels_may_have_neighbours_swapped(spark):
    labels = ["Friede", "Freide", "Firede", "Fried", "Friedens", "Firdee", "F", None]
    rows = spark.createDataFrame([("g", x, "f") for x in labels], "grp string, label string, file string")
    columns = {"group": "grp", "label": "label", "file": "file"}
    assert [r["label"] for r in report.search(rows, "label:friede", columns, fuzzy_label=True).collect()] == ["Friede", "Freide", "Firede", "Fried", "Friedens"]
    assert [r["label"] for r in report.search(rows, "label:friede", columns).collect()] == ["Friede", "Friedens"]
    assert report.search(rows, "label:f", columns, fuzzy_label=True).count() == 7


def test_author_mentions_by_order_span_and_negatives(spark):
    pages = spark.createDataFrame([(1, "Müller, Hans schrieb 1999. Bei Muller: nein"), (2, "niemand"), (3, None)], "page int, text string")
    targets = spark.createDataFrame([("m", ["muller"], ["m[uü]ller", "m.ller,", "m("], ["schrieb"]), ("n", ["muller"], ["m[uü]ller", "bei"], []), ("x", ["x"], ["x"], None)], "author_id string, surnames array<string>, patterns array<string>, negatives array<string>")
    got = sorted((r["page"], r["tgt"], r["start"], r["end"], r["pattern"]) for r in binding.author_mentions(pages, targets, "page").collect())
    assert got == [(1, "n", 0, 6, "m[uü]ller"), (1, "n", 27, 30, "bei"), (1, "n", 31, 37, "m[uü]ller")]


def test_bibliography_waterfalls(spark):
    files_ = spark.createDataFrame([(1, "Buch (Meyer, Anna).pdf"), (2, "x_alt-meyer.pdf"), (3, "Werner Karls Chronik.pdf"), (4, "nichts.pdf")], "f int, name string")
    authors = spark.createDataFrame([(0, "meyer-anna", "Meyer, Anna", ["alt-me"], None), (1, "alt", "Alt, B", ["alt-meyer"], "meyer-anna"), (2, "karl-werner", "Karls, Werner", [], None), (3, "werner", "Werner, Z", [], None)], "ordinal int, author_id string, display string, filename_aliases array<string>, merge_into string")
    assert sorted(tuple(r) for r in binding.bibliography_authors(files_, "f", authors).collect()) == [(1, "meyer-anna", 0), (2, "meyer-anna", 1), (3, "karl-werner", 2)]
    works = spark.createDataFrame([(0, "Karls_Werk", ["karls"], ["werner"]), (1, "Buch", ["^buch"], []), (2, "Werner_Karls", [], [])], "ordinal int, canonical string, aliases array<string>, negatives array<string>")
    assert sorted(tuple(r) for r in binding.bibliography_works(files_, "f", works).collect()) == [(1, "Buch", 0), (3, "Werner_Karls", 1)]


def test_canons_and_pattern_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"authors": [{"canonical_id": " a ", "display": "A", "text_aliases": ["x"], "merge_into": " "}, {"canonical_id": ""}]}))
    (tmp_path / "w.json").write_text(json.dumps({"works": [{"canonical": "W", "year": "x", "aliases": ["(?i)w"]}, {"canonical": None}, {"canonical": "V", "year": 1500}]}))
    (tmp_path / "c.json").write_text(json.dumps({"works": [{"canonical": "W (Bern)", "aliases": ["w"]}], "generic_terms": [{"label": "G", "patterns": ["g"]}], "weights": {"work": 2.0}}))
    assert [(r["ordinal"], r["author_id"], r["text_aliases"], r["filename_aliases"], r["merge_into"]) for r in canons.authors_canon(spark, str(tmp_path / "a.json")).collect()] == [(0, "a", ["x"], [], None)]
    assert [(r["canonical"], r["year"], r["negatives"]) for r in canons.works_canon(spark, str(tmp_path / "w.json")).collect()] == [("W", None, []), ("V", 1500, [])]
    assert sorted((r["kind"], r["label"], r["weight"]) for r in files.chronicle_canon(spark, str(tmp_path / "c.json")).collect()) == [("generic", "G", 1.0), ("work", "W (Bern)", 2.0)]
    chron = spark.createDataFrame([(None, "L", '["p", "q"]', "3"), ("series", None, "oops", "x")], "kind string, label string, patterns_json string, weight string")
    old, generic = spark.createDataFrame([("W", '["o"]')], "canonical string, aliases_json string"), spark.createDataFrame([("g",), ("",)], "pattern string")
    rows = lambda **t: sorted(tuple(r) for r in canons.canon_patterns(t).collect())
    assert rows(chroniken_canon=chron, works_canon=old, generic_terms=generic) == [("L", "work", "p", 3.0), ("L", "work", "q", 3.0), ("generic", "generic", "g", 1.0)]
    assert rows(works_canon=old) == [("W", "work", "o", 1.0)]
    with pytest.raises(ValueError, match="chroniken_canon"):
        canons.canon_patterns({"generic_terms": generic})


def test_staged_lines_sqlite_and_terms(spark, tmp_path, monkeypatch):
    import sqlite3

    (tmp_path / "m.jsonl").write_text('{"a": 1, "b": "x"}\nno\n\n{"a": 2}\n[1]\n')
    assert sorted(tuple(r) for r in canons.staged_lines(spark, str(tmp_path / "m.jsonl"), "a long, b string").collect()) == [(1, "x"), (2, None)]
    con = sqlite3.connect(tmp_path / "t.db")
    con.execute("CREATE TABLE works (id INTEGER PRIMARY KEY, title TEXT)")
    con.execute("CREATE TABLE none (id INTEGER)")
    con.executemany("INSERT INTO works VALUES (?, ?)", [(i, f"t{i}") for i in range(1, 30, 2)])
    con.commit()
    monkeypatch.setattr(canons, "SQLITE_ROWS", 10)
    assert sorted(tuple(r) for r in canons.sqlite_table(spark, str(tmp_path / "t.db"), "works", "title string, id long").collect()) == sorted((f"t{i}", i) for i in range(1, 30, 2))
    assert canons.sqlite_table(spark, str(tmp_path / "t.db"), "none", "id long").count() == 0
    (tmp_path / "terms.csv").write_text('term\nReferences,x\n"Literatur"\n\nreferences\n')
    assert {r["term"] for r in canons.terms_list(spark, str(tmp_path / "terms.csv")).collect()} == {"references", "literatur"}


def test_lexicon_hits_and_context(spark):
    docs = spark.createDataFrame([(1, "Der Friede, frieden und accordeon"), (2, "Ein Abschied allein"), (3, "Der Abschied nach dem Krieg"), (4, None)], "doc_id int, text string")
    got = sorted((r["doc_id"], r["category"], r["start"], r["end"]) for r in keywords.lexicon_hits(docs, "doc_id").collect())
    assert got == [(1, "core_peace", 12, 19), (1, "legal_instrument", 24, 30), (3, "legal_instrument", 4, 12)]
    assert sorted((r["doc_id"], r["start"]) for r in keywords.lexicon_hits(docs, "doc_id", strict=True).collect()) == [(1, 12), (3, 4)]


def test_small_binding_functions(spark):
    assert one(spark, canons.label_of(F.col("t")), t='"Die Chronik" (Bern), ') == "Die Chronik" and one(spark, canons.label_of(F.col("t")), t=", Werk, (x") == "Werk"
    assert one(spark, canons.name_in_parentheses(F.col("t")), t="x (Müller, Ä)") == "muller, a"
    assert one(spark, T.finder_context(F.col("t"), F.lit(2), F.lit(3), 20), t="abcdefghijklmnopqrstuvwxyz end") == "abcdefghijklmnopqrstuvwxyz"
    assert json.loads(binding.session_meta("s", "2020", ["b", "a"], {"x": 1}))["files"] == ["a", "b"]
    nodes = spark.createDataFrame([("Bern",), ("Basel",)], "label string")
    assert binding.searched_labels(nodes, "label", "be", exact=True).count() == 0 and binding.searched_labels(nodes, "label", "BA").count() == 1
