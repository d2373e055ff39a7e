"""Alignment, main texts and clusters against plain Python, on the registered queries and on awkward rows."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
from bisect import bisect_right
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import alignment, clustering, pages, queries
from scriptorium.llm.tokens import tokenizer_path
from tests import oracle

from .cases import awkward, prose, table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def encoder():
    return alignment.PairEncoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def library(encoder, text):
    """Ids and bytes of both libraries for a whole text."""
    if not text:
        return [], []
    a, b = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text)
    same = all(b"".join(table[i] for i in ids) == (" " + text).encode() for table, ids in ((encoder.a_bytes, a), (encoder.b_bytes, b)))
    return (a, b) if same else ([], [])


def test_encoder_gives_what_both_libraries_give():
    e, rng = alignment.PairEncoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")), random.Random(4)
    pool = [*"abcXYZ012 .,'\"-!$%\n\t<=_   ", "'s", "'ll", "é", "ß", "—", "漢", "🙂", "é", "\xa0", " ", "　", "▁", "<|endoftext|>", "<0x41>", "\x00", "\u0085", " the", " and"]
    e.KEPT = 300
    for _ in range(100):
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(20)] + [None, "", " ", "  x", "x" * 3000]
        got = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert (got.a[got.a_doc == i].tolist(), got.b[got.b_doc == i].tolist()) == library(e, t)
    assert e.by_parts and len(e.hash) <= 300


def test_components_are_those_of_a_search():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 20), (50, 80), (400, 399)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        if m == 399:
            u, v = np.arange(399)[::-1], np.arange(1, 400)[::-1]
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                label[a] = label[b] = min(label[a], label[b])
        assert alignment.components(n, u, v).tolist() == label


def plain_alignment(encoder, texts):
    """Links by comparing all byte ranges, groups by common borders."""
    links, out = {}, {}
    for k, text in texts.items():
        a, b = library(encoder, text)
        ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
        ea, eb = ends(a, encoder.a_bytes), ends(b, encoder.b_bytes)
        own, j = [], 0
        for i, x in enumerate(a):
            lo = ea[i - 1] if i else 0
            while j and eb[j - 1] > lo:
                j -= 1
            while j < len(b) and (eb[j - 1] if j else 0) < ea[i]:
                if eb[j] > lo:
                    own.append((x, b[j]))
                j += 1
        groups, borders = [], sorted(set(ea) & set(eb))
        for lo, hi in zip([0, *borders], borders, strict=False):
            groups.append("|".join(",".join(map(str, ids[bisect_right(end, lo) : bisect_right(end, hi)])) for ids, end in ((a, ea), (b, eb))))
        links[k], out[k] = own, (len(a), len(b), groups)
    held = Counter(p for own in links.values() for p in set(own))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return {k: (n_a, n_b, len(g), len(links[k]), sum(held[p] == most[p[0]] for p in links[k]), sum(held[p] for p in links[k]), sha(";".join(g))) for k, (n_a, n_b, g) in out.items()}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@needs_data
def test_op11_equals_plain_python(spark, encoder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, DATA).collect()}
    assert got == plain_alignment(encoder, texts)


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_alignment_awkward(spark, encoder, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    want = plain_alignment(encoder, dict(enumerate(r[1] for r in awkward())))
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.alignment(table(spark)).collect()]
    assert sorted(got) == sorted(want.values())
    assert alignment.alignment(table(spark, [])).count() == 0
    groups = alignment.token_groups(table(spark)).collect()
    assert len(groups) == len(awkward()) and all(max(r["a_group"], default=-1) == max(r["b_group"], default=-1) for r in groups)
    assert sorted(1 + max(r["a_group"], default=-1) for r in groups) == sorted(r[2] for r in want.values())


def article(page: str) -> str:
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1])
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())))


@needs_data
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op12_keeps_the_article_alone(spark, sf):
    data = f"/root/testdata/{sf}"
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.op12_main_texts(spark, data).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    largest = [r for r in got if r["url"].split("/")[2] == "blog.tionsh.example.com"]
    assert sf == "sf0.001" or sum(r["n_template"] > 0 for r in largest) > len(largest) / 2


def nameless(i: int, kind: str) -> str:
    """A page without any telling element or name: menu, notice and advert recur; passages recur in part."""
    own = f"<h1>{prose(i, 4)}</h1><p>{prose(100 + i, 30)}</p><p>A quotation that very many articles hold, word for word, as it happens.</p><p>{prose(200 + i, 20)}</p>"
    menu = "<div><div><a href='/a'>Home</a></div><div><a href='/b'>World</a></div></div>"
    notice = "<div class='x7'><p>We have changed our terms of use, please read them with care today.</p></div>"
    body = {"plain": f"{menu}<div class='x1'>{own}</div>{notice}<div>Made by nobody</div>", "article": f"{menu}<article>{own}{notice}</article><div>Made by nobody</div>"}[kind]
    return f"<html><body>{body}</body></html>"


@pytest.mark.parametrize("kind", ["plain", "article"])
def test_recurring_subtrees_go_and_passages_stay(spark, kind):
    urls = [("http://a.example/%d" % i, nameless(i, kind)) for i in range(12)] + [("http://a.example/copy%d" % i, nameless(3, kind)) for i in range(20)] + [("http://b.example/1", nameless(50, kind))]
    rows = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(urls)], "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r for r in pages.main_texts(rows).collect()}
    for k, (url, page) in enumerate(urls):
        want = [html.unescape(x) for x in re.findall(r"<(?:h1|p)>(.*?)</(?:h1|p)>", page) if "terms of use" not in x]
        if "a.example" in url:
            assert got[k]["text"].split("\n") == want and got[k]["n_template"] >= 1
        else:
            assert set(want) <= set(got[k]["text"].split("\n")) and got[k]["n_template"] == 0


def test_pages_read_as_browsers_do():
    text = lambda h: pages.Page(h).text([])[0]
    assert text("<article><p>One <b>two</b> three<p>Four<ul><li>a<li>b</ul><aside>Side</aside>x<br>y<h2>H</h3>z</article>") == "One two three\nFour\na\nb\nx y\nH\nz"
    assert text("<body><div class=nav-menu><a href=1>A</a></div><p>1 < 2 &amp; 3&nbsp;&gt; 2</p><div id='cookieNotice'>C</div>tail &#65;") == "1 < 2 & 3 > 2\ntail A"
    assert text("<main><header><h1>T</h1></header><p>p<script>var a='</p>';</script>q</p><section id=comments><article class=comment>no</article></section></main><footer>f") == "T\npq"
    assert text("<div class='content no-sidebar'><form><article><p title='a > b'>x</p><p>y <scr") == "x\ny"
    assert text("<article><table><tr><td>a<td>b<tr><td>c</table><style>p{}</style><!-- <p>no --><textarea>no</textarea></article>") == "a\nb\nc"
    assert text("<main><h1>T</h1><p>Own text.</p></main><div class='user-comments'><article><p>A long comment of a reader, longer than the text.</p></article></div>") == "T\nOwn text."
    assert text("<div class='post-content'><p>Short</p></div><div class='comments'><article><p>A long comment of a reader, longer than the text.</p></article></div>") == "Short"
    assert text("<body><h1>T</h1><p>Own text that is longer than what readers say below.</p><section id='commentSection'><article><p>A comment.</p></article></section>") == "T\nOwn text that is longer than what readers say below."
    assert text("<article><h1>T</h1><div class='alert alert-info'>Notice</div><p class='ad1'>Buy</p><div class='adsbygoogle'>x</div><div role='complementary'>Side</div><div id='share-buttons'>s</div><p>End</p><form><p>Mail</p></form></article><ul class='topnav'><li>m</ul>") == "T\nEnd"
    assert text("") == text("<p") == text("<!-- open") == "" and text("<p title='it's>x") in ("", "x")
    deep = "<div>" * 20000 + "<p>x" * 20000 + "</p>" * 30000
    assert text(deep).count("x") == 20000


def test_main_texts_awkward(spark):
    schema = "page_id long, url string, html string, text string, numbers int, page string"
    rows = [(1, "http://a/x", "<p>One</p>", "t", 1, "p"), (1, "http://a/x", "<p>One</p>", "t", 1, "p"), (None, None, None, None, None, None), (2, "no url", "", None, 2, None), (3, "//User@Host.example:8/x", "<article>" + "<p>word</p>" * 30_000 + "</article>", None, None, "z")]
    got = pages.main_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["numbers"], r["page"]) for r in got if r["page_id"] != 3) == [(0, "", 0, None, None), (1, "One", 3, 1, "p"), (1, "One", 3, 1, "p"), (2, "", 0, 2, None)]
    assert [r["n_chars"] for r in got if r["page_id"] == 3] == [30_000 * 5 - 1]
    assert pages.main_texts(spark.createDataFrame([], schema)).count() == 0
    hosts = spark.createDataFrame([(u,) for u in ("http://A.b/c", "https://u:p@x.y:80?q", "//z", "x.y/z", None)], "url string")
    assert [r[0] for r in hosts.select(pages.host(hosts["url"])).collect()] == ["a.b", "x.y", "z", "", ""]


@needs_data
def test_op13_equals_its_sql(spark):
    con = oracle.connection(DATA)
    assert oracle.differences(queries.op13_centroids(spark, DATA), con, queries.oracle_sql()["op13_centroids"]) == ""


def test_clusters_awkward(spark):
    rng = np.random.default_rng(2)
    ok = [[float(x) for x in rng.normal(size=4)] for _ in range(40)]
    rows = [(i, v, "x", 7) for i, v in enumerate(ok)] + [(i, ok[0], "x", 7) for i in range(100, 160)] + [(0, ok[0], "x", 7), (None, ok[1], None, None)]
    rows += [(200, None, "", 0), (201, [1.0], "", 0), (202, [1.0, None, 2.0, 3.0], "", 0), (203, [float("nan")] * 4, "", 0), (204, [float("inf"), 0.0, 0.0, 0.0], "", 0), (205, [3e38, 0.0, 0.0, 0.0], "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, n int")
    got = clustering.clusters(df.repartition(3), k=3, rounds=6, dimensions=4).collect()
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 4 and all(x is not None and abs(x) < 1e30 for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:3]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(6):
        own = [[v for _, v in kept if near(v)[1] == k] for k in range(3)]
        centroids = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, centroids, strict=True)]
    want = sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept)
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(w[2] for w in want)} and all(r["centroid"] == centroids[r["cluster"]] for r in got)
    assert clustering.clusters(df.where("vec_id > 199"), dimensions=4).count() == 0 and clustering.clusters(df.where("vec_id in (1, 2)"), dimensions=4).count() == 2
    far = np.array([[1 << 27, -(1 << 27)], [0, 0]])
    best, distance = clustering.nearest(far, np.array([[0, 0], [1 << 27, 1 - (1 << 27)]]))
    assert best.tolist() == [1, 0] and distance.tolist() == [1, 0]


def test_items_repeated_in_one_text_end_in_time(spark):
    """Eight items that are beginnings of one passage, and a text that repeats the passage for 5,000 words."""
    from scriptorium.llm import decontamination

    passage = prose(77, 130).split()
    bench = spark.createDataFrame([(i, " ".join(passage[: 60 + 10 * i])) for i in range(8)], "item_id long, text string")
    text = " ".join((passage * 40)[:5_000])
    began = time.time()
    got = {r["item_id"]: (r["start"], r["similarity"], r["windows"]) for r in decontamination.contamination(table(spark, [(1, text, "en", "s", 1, 1, "x", None), (2, prose(5, 90), "en", "s", 1, 1, "x", None)]), bench).collect()}
    assert got.keys() == set(range(8)) and all(r[:2] == (0, 1.0) and r[2] >= 38 for r in got.values())
    assert time.time() - began < 150
