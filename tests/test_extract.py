"""DOCX files and cascades of extractors."""

from __future__ import annotations

import io
import zipfile

import pytest

from scriptorium.sinks import reports
from scriptorium.sources import extract, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(*runs: str) -> str:
    return f"<w:p>{''.join(f'<w:r>{r}</w:r>' for r in runs)}</w:p>"


def test_docx_paragraphs():
    body = p("<w:t>Erster</w:t>", '<w:tab/><w:t xml:space="preserve"> Teil &amp; Ähre</w:t>') + p() + "<w:tbl><w:tr><w:tc>" + p("<w:t>Zelle</w:t>") + "</w:tc></w:tr></w:tbl>" + p("<w:t>a</w:t><w:br/><w:t>b</w:t><w:noBreakHyphen/>") + "<w:sectPr/>"
    assert extract.docx_pages(docx(body)) == ["Erster\t Teil & Ähre\n\na\nb-"]
    assert extract.docx_pages(docx("")) == [""]
    many = extract.docx_pages(docx("".join(p(f"<w:t>{'x' * 90}{i}</w:t>") for i in range(100))), most=1000)
    assert len(many) > 5 and all(len(x) <= 1000 for x in many) and "\n".join(many).count("\n") == 99
    for bad in (b"", b"PK\x03\x04", b"text", docx("<w:p>")):
        with pytest.raises(ValueError, match="no DOCX"):
            extract.docx_pages(bad)


def test_docx_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(p("<w:t>Hallo</w:t>")))
    (tmp_path / "b.DOCX").write_bytes(docx(p("<w:t>Welt</w:t>")))
    (tmp_path / "bad.docx").write_bytes(b"broken")
    found = files.document_files(spark, str(tmp_path), ("docx",))
    got = files.extracted_pages(found, extract.docx_pages).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["page"], r["text"]) for r in got) == [("a.docx", 1, "Hallo"), ("b.DOCX", 1, "Welt")]


GOOD = "Die Chronik berichtet von den Taten der Alten und den Kriegen der Jungen. " * 8
WEAK = "-- .. ~~ ** ## ab " * 40


def test_the_best_of_several_extractors(spark, tmp_path):
    table = {"one": [[GOOD], [GOOD * 2]], "two": [[WEAK], [GOOD]], "three": [["kurz"], ["kürzer"]], "four": [None, [WEAK[:60], GOOD]], "five": [None, None], "six": [[GOOD, "x"], [GOOD * 2, WEAK[:100]]]}
    seen = tmp_path / "seen"
    seen.mkdir()

    def number(i):
        def run(content):
            name = content.decode()
            with (seen / f"{i}-{name}").open("w"):
                pass
            if table[name][i] is None:
                raise OSError
            return table[name][i]

        return run

    rows = spark.createDataFrame([(n, bytearray(n.encode())) for n in table], "path string, content binary")
    got = {(r["path"], r["page"]): (r["text"], r["extractor"]) for r in extract.best_pages(rows, [(number(0), 0.6), (number(1), 0.55)]).collect()}
    assert got == {("one", 1): (GOOD, 0), ("two", 1): (GOOD, 1) if len(GOOD) > len(WEAK) else (WEAK, 0), ("three", 1): ("kürzer", 1), ("four", 1): (WEAK[:60], 1), ("four", 2): (GOOD, 1), ("six", 1): (GOOD, 0), ("six", 2): (WEAK[:100], 1)}
    assert {x.name for x in seen.iterdir() if x.name.startswith("1-")} == {"1-two", "1-three", "1-four", "1-five", "1-six"}
    assert extract.best_pages(rows.limit(0), [(number(0), 0.6)]).count() == 0


def test_reports(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "a", 0.5), ("c", "a", 0.25)], "a string, b string, similarity double")
    table = reports.similarity_table(pairs)
    assert table.columns == ["a", "a", "b", "c"] and [tuple(r) for r in table.collect()] == [("a", 0.0, 0.5, 0.25), ("b", 0.5, 0.0, 0.0), ("c", 0.25, 0.0, 0.0)]
    with pytest.raises(ValueError, match="columns"):
        reports.similarity_table(spark.range(1200).selectExpr("cast(id as string) a", "'x' b", "0.5D similarity"))
    assert reports.filled_template("<h1>{{title}}</h1>{{body}}", {"title": "{{body}}", "body": r"\1 & b"}) == r"<h1>{{body}}</h1>\1 & b"
    with pytest.raises(ValueError, match="nothing"):
        reports.filled_template("{{nothing}}", {})
    hits = spark.createDataFrame([("work", "b", 2, 1), ("work", "a", 9, 1), ("series", "z", 1, 2)], "grp string, label string, doc_id int, page int")
    summary = spark.createDataFrame([("work", "a", 1, 3.0), ("work", "b", 5, 7.0), ("series", "z", 9, 3.0)], "grp string, label string, mentions int, weighted double")
    reports.write_mentions(hits, summary, str(tmp_path / "out"))
    lines = lambda name: next((tmp_path / "out" / name).glob("*.csv")).read_text().splitlines()
    assert lines("mentions") == ["grp;label;doc_id;page", "series;z;1;2", "work;a;9;1", "work;b;2;1"]
    assert lines("summary") == ["grp;label;mentions;weighted", "work;b;5;7.0", "series;z;9;3.0", "work;a;1;3.0"]
