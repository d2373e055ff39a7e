"""Main text of web pages by removal of site templates.

Every block element of a page is a subtree with a hash of its tag, names, and content. Spark counts for each host
in how many pages of different content a subtree recurs; those that recur in many are the site's template and go.
What recurrence can't show, as on a host with few pages, goes by its element or name (navigation, footers, forms,
adverts, comments and the like). The rest of the article is kept as it stands, paragraph by paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, staged, steps

#: A subtree is a template if it recurs in pages of so many different contents at least, and in that share of its host's.
LEAST_PAGES, LEAST_SHARE = 3, 0.005

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of a page's text.
UNSEEN = frozenset("head script style noscript template title iframe noembed noframes xmp svg math canvas object audio video map button select datalist textarea input option label progress meter".split())
#: Elements that a page has beside its article.
BESIDE = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in class or id that name such parts. Those of the second list don't count inside an article.
NAMES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertisements advertising adsense alert alerts announcement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disclaimer discussion disqus footer gdpr hidden login menu leftnav mainnav menus modal nav navbar navigation newsletter notice notices notification optin overlay pager pagination popup privacy promo promos promotion recommended related replies respond responses share sharing sidebar sidenav signup sitenav social sponsor sponsored sponsors subscribe subnav subscription teaser toc toolbar topbar topnav widget widgets".split()
)
OUTER_NAMES = frozenset("header masthead head top bottom skip search tags meta".split())
#: Words that turn such a name into something else, as in "no-sidebar".
NOT_NAMES = frozenset("free has no non enabled off on open with without".split())
#: Names that an article element has only if it isn't the page's own.
OTHER_ARTICLES = frozenset("ad ads advert comment comments promo recommended related replies respond responses sponsored teaser widget".split())
#: Class or id of an element that holds the article, where there is no article element.
MAINS = frozenset("article articlebody article-body article-content content main maincontent main-content post postbody post-body post-content entry-content story storybody story-body".split())
#: Closing one of these closes what is open inside; opening them ends an open paragraph.
_ENDS_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
_SCOPE = frozenset("html table td th caption template object body".split())
#: Which open elements a start tag ends, up to which border.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold a passage of prose; one that recurs inside an article stays.
_PROSE = _HEADINGS | frozenset("p blockquote pre dd dt td th caption figcaption address li summary".split())


class Node:
    """A block element, or one that isn't seen. parts: its own texts and child nodes in order."""

    __slots__ = ("tag", "names", "parent", "parts", "hash", "length", "linked", "named", "main", "plain", "drop")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.hash, self.length, self.linked = 0, 0, 0
        self.names, self.named, self.main, self.plain, self.drop = "", "", False, True, False


def _words(value: str) -> set[str]:
    return set(_NAME.findall(_CAMEL.sub(" ", value).lower()))


def _describe(node: Node, attributes: str) -> None:
    """What an element's attributes say of it."""
    named = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        named.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
    classes = f"{named.get('class', '')} {named.get('id', '')}"
    role = named.get("role", "").lower()
    node.names, node.plain = f"{classes} {role}", not (classes.strip() or role)
    words = set().union(*(own for c in classes.split() if not (own := _words(c)) & NOT_NAMES))
    if node.tag in ("article", "main"):
        words &= OTHER_ARTICLES
    if role in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")) or words & NAMES:
        node.named = "always"
    elif words & OUTER_NAMES:
        node.named = "outside"
    node.main = role == "main" or named.get("itemprop") == "articleBody" or bool(set(classes.lower().split()) & MAINS)


def parsed(html: str) -> tuple[Node, list[Node]]:
    """The root of a page and all its nodes in order. Unclosed and wrongly nested elements are taken as browsers do; a cut tag at the end is left out."""
    root = Node("html", None)
    nodes, stack, at, n = [], [("html", root)], 0, len(html)
    opened: Counter[str] = Counter()
    lower = None

    def pop_to(i: int) -> None:
        for tag, _ in stack[i:]:
            opened[tag] -= 1
        del stack[i:]

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1][1].parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1][1].parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not (opened[tag] or tag in _HEADINGS):
                continue
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0]
                if open_tag == tag or tag in _HEADINGS and open_tag in _HEADINGS:
                    pop_to(i)
                    break
                if open_tag in _SCOPE and tag not in ("table", "html", "body", "tr", "tbody", "thead", "tfoot") or open_tag in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag in ("html", "body"):
            if m[3].strip():
                if tag == "body":
                    _describe(root, m[3])
                    root.named, root.main = "", False
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
            if tag in _HEADINGS and stack[-1][0] in _HEADINGS:
                pop_to(len(stack) - 1)
        if tag in _IMPLIED:
            closes, borders = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in closes) else ():
                if stack[i][0] in borders:
                    break
                if stack[i][0] in closes:
                    pop_to(i)
        own = stack[-1][1]
        if tag == "br" or tag == "hr":
            own.parts.append(" " if tag == "br" else Node("hr", own.parent if own.tag == "a" else own))
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else None
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at) if lower is None else None
            end = close.start() if close else (-1 if lower is None else lower.find(f"</{tag}", at))
            at = n if end < 0 else end
            continue
        node, holder = own, own.parent if own.tag == "a" else own
        if tag in BLOCKS or tag in UNSEEN:
            node = Node(tag, holder)
            if m[3]:
                _describe(node, m[3])
            own.parts.append(node)
            nodes.append(node)
        elif tag == "a":
            node = Node("a", holder)  # an inline run: what it holds counts as linked
            own.parts.append(node)
        if not (m[3].endswith("/") and tag in ("svg", "path")):
            stack.append((tag, node))
            opened[tag] += 1
    return root, nodes


def _sum_up(root: Node, nodes: list[Node]) -> None:
    """Hash, length and linked length of every node's content, children first."""
    for node in [*reversed(nodes), root]:
        digest, length, linked = xxhash.xxh64(f"{node.tag} {node.names}"), 0, 0
        todo = list(reversed(node.parts))
        depth = 0
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                text = "".join(part.split())
                digest.update(text.encode("utf-8", "surrogatepass"))
                length += len(text)
                linked += len(text) * (depth > 0)
            elif part is None:
                depth -= 1
            elif part.tag == "a":
                depth += 1
                todo.append(None)
                todo.extend(reversed(part.parts))
            else:
                digest.update(part.hash.to_bytes(8, "little"))
                length += part.length
                linked += part.length if depth else part.linked
        node.hash, node.length, node.linked = digest.intdigest(), length, linked


class Page:
    """A parsed page: its nodes, and the nodes that hold its article."""

    def __init__(self, html: str):
        self.root, self.nodes = parsed(html)
        _sum_up(self.root, self.nodes)
        self.mains = self._mains()
        self.inside, self.around = set(), set()
        for main in self.mains:
            node = main.parent
            while node is not None:
                self.around.add(id(node))
                node = node.parent
        kept = {id(x) for x in self.mains}
        for node in self.nodes:
            if id(node) in kept or id(node.parent) in self.inside:
                self.inside.add(id(node))

    def _outermost(self, wanted, strict: bool) -> list[Node]:
        """Wanted nodes that have content and aren't inside one another or, if strict, inside what is beside an article."""
        found, seen = [], set()
        for node in self.nodes:
            if id(node.parent) in seen:
                seen.add(id(node))
            elif node.tag in UNSEEN or (strict or wanted(node)) and (node.tag in BESIDE or node.named == "always") or node.tag in ("nav", "footer", "aside") or _words(node.names) & OTHER_ARTICLES:
                seen.add(id(node))
            elif wanted(node) and node.length:
                found.append(node)
                seen.add(id(node))
        return found

    def _mains(self) -> list[Node]:
        """An article element, else main, else one named so; one in a part that is named as beside it only if it holds most of the page."""
        by_tag = (lambda x: x.tag == "article", lambda x: x.tag == "main")
        for kinds in (by_tag, (lambda x: x.main,)):
            for strict in (True, False):
                for wanted in kinds:
                    found = self._outermost(wanted, strict)
                    if found and (strict or 2 * sum(x.length for x in found) >= self.root.length):
                        return found
        return []

    def content(self) -> int:
        """Stands for what the page is about: the least hash among its article's blocks, or among all its long passages, so that copies have the same."""
        blocks = [x for x in self.nodes if id(x) in self.inside and x.tag in _PROSE and x.length] or self.mains
        if not blocks:
            blocks = [x for x in self.nodes if x.tag in _PROSE and x.length >= 100 and 2 * x.linked < x.length] or [x for x in self.nodes if x.length] or [self.root]
        return min(x.hash for x in blocks)

    def candidates(self) -> list[int]:
        """Numbers of the nodes that may be template: those with content that don't hold the article."""
        return [i for i, x in enumerate(self.nodes) if x.length and id(x) not in self.around and x not in self.mains and x.tag not in UNSEEN]

    def _stays(self, node: Node, template: set[int]) -> bool:
        """A recurring block of prose stays in an article, and elsewhere if it stands among prose that doesn't recur."""
        if node.tag not in _PROSE and not (node.tag == "div" and node.plain and not any(isinstance(p, Node) and p.tag != "a" for p in node.parts)):
            return False
        if 2 * node.linked > node.length or node.named == "always":
            return False
        if id(node) in self.inside:
            return True
        return any(isinstance(p, Node) and p.tag in _PROSE and p.length >= 40 and 2 * p.linked < p.length and id(p) not in template for p in node.parent.parts)

    def text(self, template: list[int]) -> tuple[str, int, int]:
        """Main text, and how many subtrees went as template and by their element or name."""
        recurring = {id(self.nodes[i]) for i in template}
        by_count = by_name = 0
        for node in self.nodes:
            if node.parent.drop:
                node.drop = True
            elif id(node) in recurring and not self._stays(node, recurring):
                node.drop, by_count = True, by_count + 1
            elif self._beside(node):
                node.drop, by_name = True, by_name + 1
        blocks: list[str] = []
        for main in self.mains or [self.root]:
            self._blocks(main, blocks)
        return "\n".join(blocks), by_count, by_name

    def _beside(self, node: Node) -> bool:
        if id(node) in self.around or node in self.mains:
            return False
        if node.tag in UNSEEN or node.tag in BESIDE:
            return True
        if node.named == "always" or node.named == "outside" and id(node) not in self.inside:
            return True
        if node.tag == "header":
            return id(node) not in self.inside
        return not self.mains and node.tag in ("ul", "ol", "dl", "table", "div", "section", "p") and node.length > 0 and node.linked >= 0.6 * node.length and sum(1 for _ in _links(node)) > 1

    @staticmethod
    def _blocks(node: Node, out: list[str]) -> None:
        """Texts of the blocks under a node: inline runs between the borders of blocks."""
        run: list[str] = []

        def close() -> None:
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

        todo: list = [node]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                run.append(part)
            elif part is None:
                close()
            elif part.tag == "a":
                todo.extend(reversed(part.parts))
            elif part.drop:
                if part.tag in BLOCKS:
                    close()
            else:
                close()
                todo.append(None)
                todo.extend(reversed(part.parts))
        close()


def _links(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, Node):
                if part.tag == "a":
                    yield part
                todo.append(part)


def host(url: Column) -> Column:
    """The host of an address in lower case without port and user; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(subtrees: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, hash of subtrees that recur on enough pages of different content of their host. subtrees: host, content, hashes."""
    contents = subtrees.groupBy("host").agg(F.countDistinct("content").alias("contents"))
    each = subtrees.select("host", "content", F.explode(F.array_distinct("hashes")).alias("hash")).distinct()
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(contents, "host").where(F.col("pages") >= F.col("contents") * least_share).select("host", "hash")


def main_texts(pages: DataFrame, *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """All columns of pages, then text, n_chars, n_template, n_named: each page's main text without its site's template.

    pages has url and html; n_template and n_named count the subtrees that went because they recur on the host and
    because of their element or name. An article element, else main, else an element named as one, else the whole page
    is the article; its own passages stay even where they recur (copies, quotations). Copies of one article count once in
    the search for templates. Character references are decoded, white space in a block is one space, blocks are joined
    by line breaks. Null or empty html: ''. A null url is a host of its own (''). Repeated rows are kept. Columns named
    like new ones are replaced. No rows: no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    page = free_name("page", *pages.columns)
    marked = pages.withColumn(page, F.struct(host("url").alias("host"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("key")))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            contents, numbers, hashes = [], [], []
            for html in batch.column("html").to_pylist():
                own = Page(html or "")
                numbers.append(own.candidates())
                contents.append(own.content())
                hashes.append([own.nodes[i].hash for i in numbers[-1]])
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "host": batch.column("host"), "key": batch.column("key"), "content": signed(contents),
                "numbers": pa.array(numbers, pa.list_(pa.int32())), "hashes": pa.array([signed(h) for h in hashes], pa.list_(pa.int64())),
            })

    html = marked.select(F.col(f"{page}.host").alias("host"), F.col(f"{page}.key").alias("key"), "html")
    found = staged(html.mapInArrow(subtrees, "host string, key string, content long, numbers array<int>, hashes array<long>"), "subtrees")
    known = staged(templates(found, least_pages, least_share), "templates")
    each = found.dropDuplicates(["host", "key"]).select("host", "key", F.explode(F.arrays_zip("numbers", "hashes")).alias("s")).select("host", "key", F.col("s.numbers").alias("number"), F.col("s.hashes").alias("hash"))
    gone = staged(each.join(known.hint("merge"), ["host", "hash"]).groupBy("host", "key").agg(F.collect_list("number").alias("numbers")), "gone")
    new = {"text", "n_chars", "n_template", "n_named"}
    kept = [c for c in marked.columns if c.lower() not in new and c != page]
    numbers = free_name("numbers", *pages.columns, *new)
    on = (F.col(f"{page}.host") == gone["host"]) & (F.col(f"{page}.key") == gone["key"])
    joined = marked.join(gone.hint("merge"), on, "left").select(*[marked[c] for c in kept], gone["numbers"].alias(numbers))
    out = pa.schema([("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64()), ("n_named", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            rows = [Page(h or "").text(t or []) for h, t in zip(batch.column("html").to_pylist(), batch.column(numbers).to_pylist(), strict=True)]
            made = pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "n_chars": [len(r[0]) for r in rows], "n_template": [r[1] for r in rows], "n_named": [r[2] for r in rows]}, schema=out)
            own = [c for c in batch.schema.names if c != numbers]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made.columns], names=[*own, *out.names])

    schema = joined.drop(numbers).schema
    for name, kind in (("text", "string"), ("n_chars", "long"), ("n_template", "long"), ("n_named", "long")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(extract, schema)
