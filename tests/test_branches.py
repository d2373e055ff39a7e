"""That registered queries have rows in each of their branches, so that their equality with SQL says something (results of the SQL, which the queries equal)."""

from __future__ import annotations

from pathlib import Path

import pytest

from scriptorium.plans import binding, catalogue, library, mentions, networks  # noqa: F401
from scriptorium.plans.registry import SQL

from tests import oracle

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")

#: Conditions of which each has to hold for some row.
BRANCHES = {
    "bibliography_headings": ("in_bib = 1", "in_bib = 0"),
    "bib_pages_of_flat_text": ("in_bib = 1", "in_bib = 0", "in_bib = 0 AND turn % 3 = 0"),
    "page_scores": ("score > 2", "score = 0", "score > 0 AND score < 2"),
    "page_score_block": ("mean_score > 2", "length > 1", "last > first"),
    "sentence_split_tags": ("marked LIKE '%CITATION? + SENT%'", "marked LIKE '%⟦CITATION?⟧'", "marked LIKE '%⟦SENTIMENT⟧'", "marked = sentence"),
    "sentence_cache_reuse": ("n_reused > 0", "n_moved > 0", "n_reused < n_sentences"),
    "cleaner_line_statistics": ("n_furniture > 1", "n_lines > n_furniture"),
    "html_page_variables": ("system IS NOT NULL AND pid IS NOT NULL AND manifest IS NOT NULL", "system IS NULL", "n_pages = 2", "n_pages = 1", "n_pages = 0"),
    "rowset_difference": ("whole >= 0",),
    "resolve_waterfall": ("step = 0", "step = 1"),
    "works_bound_by_key_or_words": ("step = 0", "step = 1 AND confidence < 1"),
    "foreign_waterfall": tuple(f"step = {i}" for i in range(5)),
    "ocr_triage": ("state = 'needs_ocr'", "state = 'not_in_library'", "state = 'in_library'", "state = 'error'"),
    "decorated_edges": ("src_label = CAST(src AS VARCHAR)", "src_label <> CAST(src AS VARCHAR)"),
    "get_or_create_authors": ("is_new", "NOT is_new"),
    "german_order": ("place = 1",),
    "works_written_back": ("version = 3",),
}


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_every_branch_has_rows(con, name):
    counts = con.execute(f"SELECT {', '.join(f'count(*) FILTER ({c})' for c in BRANCHES[name])} FROM ({SQL[name]})").fetchone()
    assert all(counts), dict(zip(BRANCHES[name], counts, strict=True))
