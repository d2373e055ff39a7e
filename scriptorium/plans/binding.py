"""Queries that bind files and mentions to authors and works, and small filters of the catalogue's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranks import ranked
from ..operators import binding, sections
from ..sources import canons
from .registry import query


@query("""SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ',' END, ' ,') AS label FROM part""")
def canonical_labels(t):
    """Labels of names in quotes, with what is in parentheses after them."""
    canonical = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.concat("p_name", F.lit(","))), F.lit(" ("), "p_brand", F.lit(")"))
    return t.part.select("p_partkey", canons.label_of(canonical).alias("label"))


@query(r"""WITH f AS (SELECT doc_id, text, strpos(text, 'tion') - 1 AS s FROM documents WHERE strpos(text, 'tion') > 0),
w AS (SELECT *, greatest(0, (2 * s + 4) // 2 - 80) AS lo FROM f), x AS (SELECT *, least(length(text), lo + 160) AS hi FROM w)
SELECT doc_id, trim(regexp_replace(regexp_extract(substr(text, 1, lo), '[\p{L}\p{N}]*$') || substr(text, lo + 1, hi - lo) || regexp_extract(substr(text, hi + 1), '^[\p{L}\p{N}]*'), '\s+', ' ', 'g')) AS context FROM x""")
def finder_contexts(t):
    """The first match of a word part, with a window that ends at words."""
    start = F.instr("text", "tion") - 1
    return t.documents.where(start >= 0).select("doc_id", T.finder_context(F.col("text"), start, start + 4).alias("context"))


@query(r"""WITH h AS (SELECT doc_id, lang, CASE WHEN contains(lower(strip_accents(text)), 'keit') THEN len(regexp_extract_all(text, '(?i)keit(en)?')) ELSE 0 END AS a,
CASE WHEN contains(lower(strip_accents(text)), 'mente') THEN len(regexp_extract_all(text, '(?i)mente[, ]')) ELSE 0 END AS b FROM documents),
u AS (SELECT lang, 'keiten' AS tgt, a AS n FROM h UNION ALL SELECT lang, 'mente', b FROM h)
SELECT coalesce(lang, 'none') AS src, tgt, CAST(sum(n) AS BIGINT) AS mentions FROM u GROUP BY 1, 2 HAVING sum(n) > 0""")
def author_mention_counts(t):
    """How often texts of a language name two authors; the third is never named in a permitted context."""
    rows = [("keiten", ["keit"], ["keit(en)?", "keit("], []), ("mente", ["mente"], ["mente[, ]"], ["(?!)"]), ("never", ["e"], ["e"], ["e"])]
    targets = t.spark.createDataFrame(rows, "author_id string, surnames array<string>, patterns array<string>, negatives array<string>")
    pages = t.documents.select(F.coalesce("lang", F.lit("none")).alias("src"), "doc_id", "text")
    return binding.author_mentions(pages, targets, "src", "doc_id").groupBy("src", "tgt").agg(F.count("*").alias("mentions"))


@query("SELECT o_custkey AS from_doc, 'VIRT_AUTHOR_' || l_suppkey || '.pdf' AS to_doc, CAST(count(*) AS DOUBLE) AS weight, 'authors_search' AS raw_source FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey")
def edges_to_virtual_authors(t):
    cited = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return binding.virtual_author_edges(cited, "o_custkey", "l_suppkey")


@query("""WITH h AS (SELECT l_suppkey AS src, l_partkey AS tgt, 'p' || l_linenumber || ': ' || left(l_returnflag || ' ' || l_orderkey, 240) AS s, l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY l_orderkey, l_linenumber) AS n FROM h)
SELECT src, tgt, count(*) AS weight, string_agg(s, ' || ' ORDER BY n) FILTER (n <= 5) AS samples FROM r GROUP BY src, tgt""")
def edges_with_five_samples(t):
    hits = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"), "l_orderkey", "l_linenumber", F.concat_ws(" ", "l_returnflag", F.col("l_orderkey").cast("string")).alias("context"))
    return binding.sampled_edges(hits, "src", "tgt", "l_linenumber", "context", ["l_orderkey", "l_linenumber"])


def _files(t):
    """Suppliers' files, named by their nation in one of four ways."""
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    key, low = F.col("s_suppkey").cast("string"), F.lower("n_name")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Werk "), key, F.lit(" ("), "n_name", F.lit(", Land).pdf"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("x"), key, F.lit("_alias-"), F.replace(low, F.lit("_"), F.lit("")), F.lit("-end.pdf"))).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("Land im Buch "), key, F.lit(".pdf"))).otherwise(F.concat(F.lit("q"), key, F.lit(".pdf")))
    return t.supplier.join(F.broadcast(nation), "s_nationkey").select("s_suppkey", name.alias("name"))


@query("""WITH f AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 4 < 3), m AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_nationkey WHEN 1 THEN CASE WHEN s_nationkey % 5 = 4 THEN s_nationkey - 1 ELSE s_nationkey END ELSE CASE WHEN s_suppkey >= 25 THEN 0 WHEN s_suppkey % 5 = 4 THEN s_suppkey - 1 ELSE s_suppkey END END AS n, s_suppkey % 4 AS step FROM f)
SELECT s_suppkey, 'nation-' || n AS author_id, CAST(step AS INTEGER) AS step FROM m""")
def bibliography_authors(t):
    """By the name in parentheses, by file name patterns with merging, and by common words (ties: the first author)."""
    number = F.col("n_nationkey").cast("string")
    author = lambda n: F.concat(F.lit("nation-"), n.cast("string"))
    alias = F.concat(F.lit("alias-nation"), number, F.lit("-"))
    authors = t.nation.select(F.col("n_nationkey").alias("ordinal"), author(F.col("n_nationkey")).alias("author_id"), F.concat("n_name", F.lit(", Land")).alias("display"), F.array(alias, F.lit("^never$")).alias("filename_aliases"), F.when(F.col("n_nationkey") % 5 == 4, author(F.col("n_nationkey") - 1)).alias("merge_into"))
    return binding.bibliography_authors(_files(t), "s_suppkey", authors)


@query("""WITH f AS (SELECT p_partkey, p_name FROM part), w AS (SELECT * FROM (VALUES (0, 'widget_work', 'widget$', '^cold'), (1, 'gear_work', 'gear', '^never$'), (2, 'small_things', '^never$', '^never$'), (3, 'cold_things', '^never$', '^never$')) w(ordinal, canonical, alias, negative)),
a AS (SELECT p_partkey, canonical, 0 AS step FROM f JOIN w ON regexp_matches(p_name, alias) AND NOT regexp_matches(p_name, negative)),
b AS (SELECT p_partkey, ordinal, canonical, len(list_intersect(list_distinct(string_split(p_name, ' ')), string_split(canonical, '_'))) AS n FROM f, w WHERE p_partkey NOT IN (SELECT p_partkey FROM a)),
c AS (SELECT p_partkey, canonical, 1 AS step, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, ordinal) AS r FROM b WHERE n > 0)
SELECT p_partkey, canonical, step FROM a UNION ALL SELECT p_partkey, canonical, step FROM c WHERE r = 1""")
def bibliography_works(t):
    """By alias without negatives, else by common words."""
    rows = [(0, "widget_work", ["widget$"], ["^cold"]), (1, "gear_work", ["gear"], []), (2, "small_things", [], []), (3, "cold_things", [], [])]
    works = t.spark.createDataFrame(rows, "ordinal int, canonical string, aliases array<string>, negatives array<string>")
    return binding.bibliography_works(t.part.select("p_partkey", F.col("p_name").alias("name")), "p_partkey", works)


@query("SELECT c_custkey AS author_id, s AS base_id FROM (SELECT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey = c_custkey // 2) AS s FROM customer WHERE c_custkey % 3 < 2) WHERE s IS NOT NULL")
def pseudo_authors(t):
    """A pseudo author's base by the name in parentheses of its display, else of its id."""
    inner = F.concat(F.lit(" ("), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit(", Supplier)"))
    pseudo = t.customer.select("c_custkey", F.concat(F.lit("id"), F.when(F.col("c_custkey") % 3 == 1, inner).otherwise("")).alias("author_id"), F.concat(F.lit("d"), F.when(F.col("c_custkey") % 3 == 0, inner).otherwise("")).alias("display"))
    authors = t.supplier.select(F.col("s_suppkey").alias("author_id"), F.concat(F.col("s_suppkey").cast("string"), F.lit(", SUPPLIER")).alias("display"))
    named = pseudo.select(F.concat("author_id", F.lit("#"), F.col("c_custkey").cast("string")).alias("author_id"), "display")
    return binding.base_author(named, authors).select(F.substring_index("author_id", "#", -1).cast("long").alias("author_id"), "base_id")


@query("SELECT c_custkey, min(s_suppkey) AS original FROM customer JOIN supplier ON s_suppkey % 50 = c_custkey % 50 GROUP BY c_custkey")
def original_files(t):
    """The first file of the same base name, whatever its folder, ending and case."""
    texts = t.customer.select("c_custkey", F.concat(F.lit("txt/Ber"), (F.col("c_custkey") % 50).cast("string"), F.lit("ÄX.txt")).alias("name"))
    files = t.supplier.select("s_suppkey", F.concat(F.lit("/pdf/BER"), (F.col("s_suppkey") % 50).cast("string"), F.lit("ax.pdf")).alias("path"))
    return binding.original_links(texts, "c_custkey", "name", files, "s_suppkey", "path")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def works_updated(t):
    """New names for every fifth work, new sizes for every tenth."""
    changes = t.part.where("p_partkey % 5 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).alias("p_size"))
    return binding.updated(t.part.select("p_partkey", "p_name", "p_size"), changes, "p_partkey")


def _author_edges(t):
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    return e.agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("bib_hits"), F.sum((F.col("l_returnflag") != "R").cast("long")).alias("text_hits"), F.max("l_linestatus").alias("examples"))


_EDGES_SQL = "WITH e AS (SELECT l_suppkey AS src, l_partkey AS tgt, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS bib_hits, CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS text_hits, max(l_linestatus) AS examples FROM lineitem GROUP BY ALL) SELECT * FROM e WHERE "


@query(_EDGES_SQL + "contains(lower(src || ' ' || tgt || ' ' || examples), '1 f') AND text_hits > 0 AND bib_hits > 0")
def author_edges_filtered(t):
    return binding.filtered_edges(_author_edges(t), "1 F", only_text=True, only_bib=True)


@query(_EDGES_SQL + "src = 1")
def edges_focus_citing(t):
    return binding.focused(_author_edges(t), 1, cited=False)


@query(_EDGES_SQL + "tgt = 1")
def edges_focus_cited(t):
    return binding.focused(_author_edges(t), 1, cited=True)


@query("SELECT c_custkey, c_custkey % 4 < 2 AS finder, c_custkey % 4 IN (0, 3) AS search FROM customer")
def chronicle_source_files(t):
    """Both rules of what a chronicle's file is called."""
    k = F.col("c_custkey") % 4
    path = F.concat(F.lit("/a/"), F.when(k == 0, "Chr_").when(k == 1, "chr-").otherwise("x_chr_"), "c_name", F.when(k == 3, ".TXT").otherwise(".pdf"))
    return t.customer.select("c_custkey", binding.from_source_file(path).alias("finder"), binding.from_source_file(path, texts_too=True).alias("search"))


@query("SELECT p_brand, count(*) FILTER (p_size % 3 = 0) AS works, count(*) FILTER (p_size % 3 < 2) AS works_and_series FROM part GROUP BY p_brand")
def group_filters(t):
    hits = t.part.select("p_brand", F.element_at(F.array(F.lit("work"), F.lit("series"), F.lit("generic")), (F.col("p_size") % 3 + 1).cast("int")).alias("grp"))
    n = lambda df, name: df.groupBy("p_brand").agg(F.count("*").alias(name))
    both = t.part.select("p_brand").distinct().join(n(binding.in_groups(hits), "works"), "p_brand", "left").join(n(binding.in_groups(hits, series=True), "works_and_series"), "p_brand", "left")
    return both.na.fill(0, ["works", "works_and_series"])


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS canonical_key FROM part WHERE replace(p_name, ' ', '-') LIKE '%widget%' AND p_size % 2 = 0")
def keys_without_file(t):
    """Works whose key holds a term and that have no file."""
    return t.part.where("p_size % 2 = 0").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("canonical_key")).where(F.col("canonical_key").like("%widget%"))


@query("SELECT conv_id, sum(CASE WHEN turn <= 1 THEN length(trim(coalesce(text, ''), ' ')) ELSE 0 END) > 400 AS has_text FROM conversations GROUP BY conv_id")
def text_layers(t):
    """Conversations whose first two turns hold more than 400 characters, as documents of pages."""
    return binding.has_text_layer(t.conversations, "conv_id", "turn", "text", first=1, least=400)


@query("SELECT doc_id, CAST(min(i) AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(l) BETWEEN 40 AND 8000 GROUP BY doc_id")
def first_paragraph_of_length(t):
    """The first paragraph that is neither shorter than 40 characters nor longer than 8,000."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.length("line").between(40, 8000)).groupBy("doc_id").agg((F.min("i") + 1).alias("n"))


@query(r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 3 = 1 THEN 'Quellen' || chr(10) || ' und  Literatur' WHEN turn % 3 = 2 THEN 'Literatur' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END, '\s+', ' ', 'g')) AS f FROM conversations),
h AS (SELECT conv_id, min(turn) AS first FROM p WHERE regexp_matches(f, '(?im)""" + "|".join(f"(?:{h})" for h in sections.HEADINGS) + r"""') GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN turn >= first THEN 1 ELSE 0 END AS in_bib FROM p LEFT JOIN h USING (conv_id)""")
def bib_pages_of_flat_text(t):
    """From the first page whose text, on one line, is a heading: the finder flattens pages first, so a heading above other text doesn't count."""
    k, own = F.col("turn") % 3, F.coalesce("text", F.lit(""))
    text = F.when(k == 1, "Quellen\n und  Literatur").when(k == 2, F.concat(F.lit("Literatur\n"), own)).otherwise(own)
    pages = t.conversations.select("conv_id", "turn", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("flat"))
    return sections.to_the_end(pages, "conv_id", "turn", sections.heading(F.col("flat"))).select("conv_id", "turn", "in_bib")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 0 WHEN bool_or(o_orderpriority = '1-URGENT') THEN 1 ELSE 2 END AS detector, CASE WHEN bool_or(o_orderstatus = 'P') THEN min(o_orderkey) FILTER (o_orderstatus = 'P') WHEN bool_or(o_orderpriority = '1-URGENT') THEN min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') ELSE min(o_orderkey) END AS first, CASE WHEN bool_or(o_orderstatus = 'P') THEN max(o_orderkey) FILTER (o_orderstatus = 'P') WHEN bool_or(o_orderpriority = '1-URGENT') THEN max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') ELSE max(o_orderkey) END AS last FROM orders GROUP BY o_custkey")
def section_detectors(t):
    """Three detectors in order of trust; each document's section is that of the first that finds one."""
    span = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return binding.found_sections([span(t.orders.where("o_orderstatus = 'P'")), span(t.orders.where("o_orderpriority = '1-URGENT'")), span(t.orders)], "o_custkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'r#00000000')")
def label_search(t):
    return binding.searched_labels(t.supplier.select("s_suppkey", "s_name"), "s_name", "R#00000000")


@query("SELECT p_partkey, CASE WHEN list_contains(string_split(lower(p_name), ' '), 'widget') THEN array_to_string(string_split(p_name, ' '), ' ') ELSE 'Widget ' || p_name END AS terms FROM part")
def seed_terms(t):
    """The seed stands first among a work's terms unless it is one of them."""
    return t.part.select("p_partkey", F.array_join(binding.injected(F.split("p_name", " "), F.lit("Widget")), " ").alias("terms"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY n COLLATE de, n, s_suppkey) AS place FROM (SELECT s_suppkey, ['Ärzte', 'arzt', 'Arzt', 'Zürich', 'Straße', 'strasse', 'ø', 'öl', '10'][1 + s_suppkey % 9] || CASE WHEN s_suppkey % 2 = 0 THEN ' ' || s_name ELSE '' END AS n FROM supplier)""")
def german_order(t):
    """All names as German readers sort them."""
    words = F.array(*map(F.lit, ("Ärzte", "arzt", "Arzt", "Zürich", "Straße", "strasse", "ø", "öl", "10")))
    n = F.concat(F.element_at(words, (1 + F.col("s_suppkey") % 9).cast("int")), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), "s_name")).otherwise(""))
    names = t.supplier.select("s_suppkey", n.alias("n"))
    return ranked(names, binding.locale_order(F.col("n"), "de", F.col("s_suppkey"))).select("s_suppkey", "place")
