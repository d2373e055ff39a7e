"""Queries on mentions: summaries, co-mention, families, samples, sections, cleaning, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import new_folder, spread
from ..operators import citations, cleaning, keywords, mentions, report, sections
from ..operators import edges as E
from ..sources import files
from .registry import Tables, query

#: label, group, integer weight: a constant canon of frequent words of the corpus.
CANON = (
    ("the", "work", 3), ("and", "work", 3), ("that", "series", 2), ("with", "series", 2), ("les", "work", 3), ("que", "generic", 1),
    ("und", "work", 3), ("der", "series", 2), ("nicht", "generic", 1), ("los", "work", 3), ("una", "series", 2), ("por", "generic", 1),
)
ROOTS = ("er", "on", "st", "be", "en", "in", "th", "re", "an", "nd")


def canon(t: Tables):
    return t.spark.createDataFrame(CANON, "label string, grp string, weight int")


def hits(t: Tables, *keep: str):
    """Counts by document and label; only the columns asked for are read beside the text."""
    return mentions.token_mentions(t.documents, canon(t), *keep)


_VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in CANON)
HITS = rf"""WITH canon(label, grp, weight) AS (VALUES {_VALUES}),
tok AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS token FROM documents),
hits AS (SELECT doc_id, lang, source, label, grp, weight, CAST(count(*) AS BIGINT) AS cnt FROM tok JOIN canon ON token = label GROUP BY ALL)
"""
FAMILIES = {v: r for r in ROOTS for v in keywords.variants(r)}
_FAMILY = ", ".join(f"('{v}', '{r}')" for v, r in FAMILIES.items())
FAMILY_HITS = rf"""WITH fam(token, root) AS (VALUES {_FAMILY}),
tok AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS token FROM documents),
hits AS (SELECT doc_id, source, root, CAST(count(*) AS BIGINT) AS cnt FROM tok JOIN fam USING (token) GROUP BY ALL)
"""


def family_hits(t: Tables):
    fam = t.spark.createDataFrame(list(FAMILIES.items()), "label string, root string")
    each = mentions.token_mentions(t.documents, fam, "source")
    return each.groupBy("doc_id", "source", "root").agg(F.sum("cnt").alias("cnt"))


@query(HITS + "SELECT grp, label, CAST(sum(cnt) AS BIGINT) AS mentions, count(DISTINCT doc_id) AS docs, CAST(sum(cnt) * weight AS BIGINT) AS weighted FROM hits GROUP BY grp, label, weight")
def mention_summary(t):
    return mentions.summary(hits(t))


@query(HITS + "SELECT lang, label, m AS mentions FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m DESC, label) AS n FROM (SELECT lang, label, CAST(sum(cnt) AS BIGINT) AS m FROM hits GROUP BY ALL)) WHERE n <= 10")
def mention_summary_bylang_top10(t):
    each = hits(t, "lang").groupBy("lang", "label").agg(F.sum("cnt").alias("mentions"))
    return mentions.sampled(each, ["lang"], [F.desc("mentions"), "label"], 10)


@query(HITS + "SELECT a.label AS a, b.label AS b, count(*) AS weight FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.label < b.label GROUP BY ALL")
def comention_edges(t):
    return mentions.co_mentions(hits(t), "doc_id", "label")


@query(HITS + "SELECT source AS doc, label, CAST(sum(cnt) AS BIGINT) AS weight FROM hits GROUP BY ALL")
def bipartite_edges(t):
    return E.bipartite(hits(t, "source").withColumnRenamed("source", "doc"), "doc", "label", F.col("cnt"))[1]


@query(HITS + ", e AS (SELECT DISTINCT source, label FROM hits) SELECT label AS id, 'label' AS role, count(*) AS mentions, CAST(0 AS BIGINT) AS items FROM e GROUP BY label UNION ALL SELECT source, 'document', CAST(0 AS BIGINT), count(*) FROM e GROUP BY source")
def bipartite_nodes(t):
    return E.bipartite(hits(t, "source"), "source", "label", F.col("cnt"))[0]


@query(HITS + "SELECT grp, CAST(sum(cnt) AS BIGINT) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY grp")
def keyword_totals_by_category(t):
    return hits(t).groupBy("grp").agg(F.sum("cnt").alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"))


@query(HITS + "SELECT label, CAST(sum(cnt) AS BIGINT) AS n_hits FROM hits GROUP BY label ORDER BY n_hits DESC, label LIMIT 20")
def keyword_totals_by_term(t):
    return hits(t).groupBy("label").agg(F.sum("cnt").alias("n_hits")).orderBy(F.desc("n_hits"), "label").limit(20)


@query(HITS + "SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_hits FROM hits GROUP BY doc_id ORDER BY n_hits DESC, doc_id LIMIT 20")
def keyword_top_files(t):
    return hits(t).groupBy("doc_id").agg(F.sum("cnt").alias("n_hits")).orderBy(F.desc("n_hits"), "doc_id").limit(20)


@query(HITS + "SELECT doc_id, CAST(sum(CASE WHEN grp = 'work' THEN cnt ELSE 0 END) AS BIGINT) AS work, CAST(sum(CASE WHEN grp = 'series' THEN cnt ELSE 0 END) AS BIGINT) AS series, CAST(sum(CASE WHEN grp = 'generic' THEN cnt ELSE 0 END) AS BIGINT) AS generic FROM hits GROUP BY doc_id")
def keyword_file_pivot(t):
    return keywords.zero_filled_pivot(hits(t), "doc_id", "grp", ("work", "series", "generic"))


@query(FAMILY_HITS + "SELECT root, CAST(sum(cnt) AS BIGINT) AS n_hits, count(*) AS n_docs FROM hits GROUP BY root")
def family_totals(t):
    return family_hits(t).groupBy("root").agg(F.sum("cnt").alias("n_hits"), F.count("*").alias("n_docs"))


@query(FAMILY_HITS + "SELECT a.root AS a, b.root AS b, count(*) AS weight FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.root < b.root GROUP BY ALL")
def family_cooccurrence(t):
    return mentions.co_mentions(family_hits(t), "doc_id", "root")


@query(FAMILY_HITS + "SELECT source, " + ", ".join(f"CAST(sum(CASE WHEN root = '{r}' THEN cnt ELSE 0 END) AS BIGINT) AS \"{r}\"" for r in ROOTS[:8]) + ", CAST(sum(CASE WHEN root NOT IN (" + ", ".join(f"'{r}'" for r in ROOTS[:8]) + ") THEN cnt ELSE 0 END) AS BIGINT) AS \"Sonstige\" FROM hits GROUP BY source")
def file_by_family_pivot(t):
    return keywords.top_pivot_with_rest(family_hits(t), "source", "root", list(ROOTS[:8]))


@query(FAMILY_HITS + "SELECT source AS author, CAST(sum(cnt) AS BIGINT) AS n_hits FROM hits GROUP BY source ORDER BY n_hits DESC, author LIMIT 15")
def family_authors_top15(t):
    return family_hits(t).groupBy(F.col("source").alias("author")).agg(F.sum("cnt").alias("n_hits")).orderBy(F.desc("n_hits"), "author").limit(15)


_AT = "instr(lower(text), 'nicht') - 1"


@query(f"SELECT doc_id, {_AT} AS start, substr(text, greatest(0, {_AT} - 30) + 1, {_AT} - greatest(0, {_AT} - 30)) || '[[' || substr(text, {_AT} + 1, 5) || ']]' || substr(text, {_AT} + 6, 30) AS kwic FROM documents WHERE instr(lower(text), 'nicht') > 0")
def kwic_first(t):
    start = F.instr(F.lower("text"), "nicht") - 1
    found = t.documents.where(start >= 0).withColumn("start", start.cast("long"))
    return found.select("doc_id", "start", T.kwic(F.col("text"), F.col("start").cast("int"), (F.col("start") + 5).cast("int"), 30).alias("kwic"))


#: Texts cut into words and what is between, with the place of each part: word edges as in find_spans, without looking around.
PARTS = r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ps FROM documents),
e AS (SELECT doc_id, text, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM p),
w AS (SELECT doc_id, text, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS "end" FROM e),
s AS (SELECT doc_id, text, part AS matched, lower(part) AS word, "end" - length(part) AS start, "end" FROM w)
"""


@query(PARTS + """SELECT doc_id, CASE word WHEN 'nicht' THEN 0 ELSE 1 END AS ordinal, start, "end",
substr(text, greatest(0, start - 40) + 1, start - greatest(0, start - 40)) || '[[' || matched || ']]' || substr(text, "end" + 1, 40) AS kwic
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY start) AS n FROM s WHERE word IN ('nicht', 'que')) WHERE n <= 4""")
def kwic_samples_max4(t):
    docs = t.documents.where(F.lower("text").rlike(r"\b(?:nicht|que)\b")).select("doc_id", "text")
    spans = mentions.find_spans(docs, [r"\bnicht\b", r"\bque\b"], "doc_id", "text")
    short = spans.select("doc_id", "ordinal", "start", "end", T.kwic(F.col("text"), F.col("start"), F.col("end"), 40).alias("kwic"))
    return mentions.sampled(short, ["doc_id", "ordinal"], ["start"], 4)


@query(PARTS + r""", c AS (SELECT doc_id, start, "end", matched, trim(regexp_replace(substr(text, greatest(0, (start + "end") // 2 - 70) + 1, 140), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS context FROM s WHERE word = 'und')
SELECT doc_id, 0 AS ordinal, start, "end", matched, context FROM c WHERE NOT regexp_matches(context, '(?i)(^|[^\p{L}\p{M}\p{N}_])nicht($|[^\p{L}\p{M}\p{N}_])|\p{Nd}{3}') AND regexp_matches(context, '(?i)(^|[^\p{L}\p{M}\p{N}_])(der|die|von)($|[^\p{L}\p{M}\p{N}_])')""")
def mentions_without_negatives(t):
    docs = t.documents.where(F.lower("text").rlike(r"\bund\b")).select("doc_id", "text")
    spans = mentions.find_spans(docs, [r"\bund\b"], "doc_id", "text").withColumn("context", T.context(F.col("text"), F.col("start"), F.col("end"))).drop("text")
    kept = mentions.without_negatives(mentions.distinct_hits(spans), [r"\bnicht\b", r"\d{3,}"])
    return mentions.with_required_context(kept, F.lit(True), r"\b(?:der|die|von)\b")


@query(r"""SELECT doc_id, length(text) AS n, CASE WHEN length(text) >= 30 AND (a >= greatest(10, length(text) // 8) OR (d >= 20 AND a + d >= greatest(25, length(text) // 4))) THEN true ELSE false END AS good, round((0.5 * a / greatest(length(text), 1) + 0.3 * least(0.3, d / greatest(length(text), 1)) + 0.2 * (a + d) / greatest(length(text), 1)) * ln(1 + length(text)) / ln(401), 6) AS score
FROM (SELECT doc_id, text, length(regexp_replace(text, '\P{L}', '', 'g')) AS a, length(regexp_replace(text, '\P{Nd}', '', 'g')) AS d FROM documents WHERE text IS NOT NULL)""")
def page_quality(t):
    docs = t.documents.where("text is not null")
    return docs.select("doc_id", F.length("text").cast("long").alias("n"), T.good_enough(F.col("text")).alias("good"), F.round(T.quality_score(F.col("text")), 6).alias("score"))


@query(r"SELECT conv_id, turn, CASE WHEN turn >= min(CASE WHEN regexp_matches(text, '(^|\n)\s*(En|De|The)[ ,.]') THEN turn END) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS in_bib FROM conversations")
def bib_section_pages(t):
    return sections.to_the_end(t.conversations, "conv_id", "turn", F.col("text").rlike(r"(^|\n)\s*(En|De|The)[ ,.]")).select("conv_id", "turn", "in_bib")


#: Turns as pages, every third of which opens with a heading.
_HEADED = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'Quellen und Literatur' || chr(10) || text WHEN turn % 5 = 4 THEN text || chr(10) || ' REFERENCES ' ELSE text END AS text FROM conversations)"


@query(f"WITH c AS {_HEADED}, h AS (SELECT conv_id, min(turn) AS first FROM c WHERE regexp_matches(text, '(?im)" + "|".join(f"(?:{h})" for h in sections.HEADINGS) + "') GROUP BY conv_id) SELECT conv_id, turn, CASE WHEN turn >= first THEN 1 ELSE 0 END AS in_bib FROM c LEFT JOIN h USING (conv_id)")
def bibliography_headings(t):
    text = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Quellen und Literatur\n"), "text")).when(F.col("turn") % 5 == 4, F.concat("text", F.lit("\n REFERENCES "))).otherwise(F.col("text"))
    pages = t.conversations.select("conv_id", "turn", text.alias("text")).withColumn("is_heading", sections.heading(F.col("text")))
    return sections.to_the_end(pages, "conv_id", "turn", F.col("is_heading")).select("conv_id", "turn", "in_bib")


_KEYWORD = r"regexp_matches(lower(text), 'ou|the')"


@query(f"""WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE {_KEYWORD}), i AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p),
r AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS length FROM i GROUP BY conv_id, g HAVING count(*) >= 2)
SELECT conv_id, first, last, length FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length DESC, first) AS n FROM r) WHERE n = 1""")
def keyword_block_longest_run(t):
    return sections.longest_run(t.conversations.where(F.lower("text").rlike("ou|the")), "conv_id", "turn")


#: Turns as pages, some of which look like a bibliography.
_CITED = "(SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'BIBLIOGRAPHY AND REFERENCES OF THE MOST WANTED AND OF THE MORE HIDDEN WORKS THAT WE USED HERE AND ELSEWHERE' || chr(10) || '[1] Kern (1987)' WHEN 2 THEN text || chr(10) || 'doi 10.1234/x' || chr(10) || 'Bock 1999' ELSE text END AS text FROM conversations)"
_PAGE_SCORE = rf"""l AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM {_CITED}), h AS (SELECT *, array_to_string(lines[1:8], chr(10)) AS head FROM l),
sc AS (SELECT conv_id, turn, round(CASE WHEN regexp_matches(head, '(?i)\b(bibliograph\w*|references?|reference\s+list|works\s+cited|literaturverzeichnis|quellen(?:verzeichnis| und literatur)?)\b') AND length(regexp_replace(head, '[^\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(head, '[^\p{{L}}]', '', 'g')), 1) >= 0.45 THEN 2.0 ELSE 0.0 END
+ len(list_filter(lines, lambda x: regexp_matches(x, '10\.\d{{4,}}/|^\s*\[\d+\]|\((1[4-9]|20)\d{{2}}\)|\b(1[4-9]|20)\d{{2}}\b'))) / greatest(len(lines), 1), 6) AS score FROM h)"""


def cited_pages(t: Tables):
    k = F.col("turn") % 4
    title = F.lit("BIBLIOGRAPHY AND REFERENCES OF THE MOST WANTED AND OF THE MORE HIDDEN WORKS THAT WE USED HERE AND ELSEWHERE\n[1] Kern (1987)")
    text = F.when(k == 1, title).when(k == 2, F.concat("text", F.lit("\ndoi 10.1234/x\nBock 1999"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.round(sections.page_score(text), 6).alias("score"))


@query(f"""WITH {_PAGE_SCORE}, m AS (SELECT conv_id, median(score) AS cut FROM sc GROUP BY conv_id),
g AS (SELECT sc.*, turn - row_number() OVER (PARTITION BY sc.conv_id ORDER BY turn) AS g FROM sc JOIN m ON sc.conv_id = m.conv_id AND score >= cut),
b AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS length, round(avg(score), 6) AS mean_score FROM g GROUP BY conv_id, g)
SELECT conv_id, first, last, length, mean_score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mean_score DESC, length DESC, first) AS n FROM b) WHERE n = 1""")
def page_score_block(t):
    return sections.scored_block(cited_pages(t), "conv_id", "turn", "score")


@query(f"WITH {_PAGE_SCORE} SELECT conv_id, turn, score FROM sc")
def page_scores(t):
    return cited_pages(t)


@query("SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn <= ceil(n * 0.25) OR turn > n - ceil(n * 0.25)")
def head_and_tail_pages(t):
    return sections.head_and_tail(t.conversations, "conv_id", "turn", 0.25, 0.25).select("conv_id", "turn")


#: Documents as scanned pages: a page number, a running head and a rule before the text.
_LINES = "SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN doc_id || chr(10) || 'BASLER CHRONIKEN' || chr(10) ELSE ' XIV ' || chr(10) || '—--' || chr(10) END || coalesce(text, ''), chr(10))) AS line FROM documents"


@query(f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(trim(line, ' '), '{'|'.join(cleaning.FURNITURE)}')) AS n_furniture, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({_LINES}) GROUP BY doc_id")
def cleaner_line_statistics(t):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("\nBASLER CHRONIKEN\n"))).otherwise(" XIV \n—--\n")
    lines = t.documents.select("doc_id", F.explode(F.split(F.concat(head, F.coalesce("text", F.lit(""))), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(cleaning.is_furniture(F.col("line"))).alias("n_furniture"), F.sum(F.length("line")).alias("n_chars"))


@query()
def clean_documents(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", cleaning.clean_edition(F.col("text")).alias("edition"), cleaning.clean_print(F.col("text")).alias("early_print"))


@query()
def paragraphs_kept(t):
    p = spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(cleaning.chronicle_paragraphs(F.coalesce("text", F.lit("")))).alias("p"))
    editorial, score = cleaning.editorial_paragraph(F.col("p")), cleaning.chronist_score(F.col("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(editorial).alias("editorial"), F.count_if(~editorial & (score >= 2)).alias("kept"), F.count_if(~editorial & (score < 2)).alias("low"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), 'E-Periodica Dokument') AS title FROM pages")
def html_titles(t):
    return t.pages.select("page_id", files.page_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, l AS link FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=\"([^\"]*)\"', 1)) AS l FROM pages)")
def html_links(t):
    return t.pages.select("page_id", F.explode(files.links(F.col("html"))).alias("link"))


_VIEWER = {"system": "iiifSystemId", "endpoint": "iiifEndpointUri", "manifest": "iiifManifestUri", "presentation": "iiifPresentationBaseUrl", "pid": "docPid"}


#: Pages as a viewer's: two thirds set the variables, a third lists its pictures, some twice.
_VIEWED = "(SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN '<script>window.epdata.iiifSystemId = ''S' || page_id || '''; window.epdata.docPid=''doc-' || page_id || '''; window.epdata.iiifManifestUri = ''' || url || '/manifest'';' || CASE WHEN page_id % 3 = 0 THEN 'pagesMinified = [[''a' || page_id || '.jpg'', 1],[''b.jpg'', 2],[''b.jpg'', 2]];' ELSE 'x=''c.jpg'';' END || '</script>' ELSE '' END || html AS html FROM pages)"


@query("SELECT page_id, " + ", ".join(rf"nullif(regexp_extract(html, 'window\.epdata\.{v}\s*=\s*''([^'']+)''', 1), '') AS {n}" for n, v in _VIEWER.items()) + rf", CAST(CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN len(list_distinct(regexp_extract_all(html, '''([^'']+?\.jpg)''', 1))) ELSE len(list_distinct(regexp_extract_all(html, '''([^'']+?\.jpg)''', 1))) END AS INTEGER) AS n_pages FROM {_VIEWED}")
def html_page_variables(t):
    number, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    listed = F.when(k == 0, F.concat(F.lit("pagesMinified = [['a"), number, F.lit(".jpg', 1],['b.jpg', 2],['b.jpg', 2]];"))).otherwise("x='c.jpg';")
    script = F.concat(F.lit("<script>window.epdata.iiifSystemId = 'S"), number, F.lit("'; window.epdata.docPid='doc-"), number, F.lit("'; window.epdata.iiifManifestUri = '"), F.col("url"), F.lit("/manifest';"), listed, F.lit("</script>"))
    v = files.page_variables(F.concat(F.when(k != 2, script).otherwise(""), "html"))
    return t.pages.select("page_id", *[c.alias(n) for n, c in v.items() if n != "pages"], F.size(v["pages"]).alias("n_pages"))


@query(r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM conversations),
e AS (SELECT conv_id, turn, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS ordinal FROM l)
SELECT conv_id, turn, CAST(ordinal AS INTEGER) AS ordinal, sentence, sentence || CASE WHEN length(sentence) > 60 AND contains(sentence, ',') THEN ' ⟦CITATION? + SENTIMENT⟧' WHEN length(sentence) > 60 THEN ' ⟦CITATION?⟧' WHEN contains(sentence, ',') THEN ' ⟦SENTIMENT⟧' ELSE '' END AS marked FROM e""")
def sentence_split_tags(t):
    s = t.conversations.select("conv_id", "turn", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("ordinal", "sentence"))
    tagged = T.mark_sentence(F.col("sentence"), F.length("sentence") > 60, F.col("sentence").contains(","))
    return s.withColumn("marked", tagged)


_SENT = "SELECT conv_id, turn, trim(s) AS sentence, o AS ordinal FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM conversations WHERE text IS NOT NULL) WHERE trim(s) <> ''"


@query(f"""WITH s AS ({_SENT}), c AS (SELECT conv_id, sentence, row_number() OVER (PARTITION BY conv_id, sentence ORDER BY turn, ordinal) AS n FROM s WHERE turn % 2 = 1),
p AS (SELECT conv_id, sentence, row_number() OVER (PARTITION BY conv_id, sentence ORDER BY turn, ordinal) AS n FROM s WHERE turn % 2 = 0)
SELECT c.conv_id, count(*) AS n_sentences, count(*) FILTER (WHERE p.n IS NULL) AS n_new FROM c LEFT JOIN p ON c.conv_id = p.conv_id AND c.sentence = p.sentence AND c.n = p.n GROUP BY c.conv_id""")
def sentence_cache_new(t):
    s = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("o", "sentence")).select("conv_id", F.trim("sentence").alias("sentence"), "turn", F.struct("turn", "o").alias("ordinal"), F.lit(True).alias("flag")).where("sentence != ''")
    found = citations.reused(s.where("turn % 2 = 1"), s.where("turn % 2 = 0"), "conv_id", "sentence", "flag")
    return found.groupBy("conv_id").agg(F.count("*").alias("n_sentences"), F.count_if("is_new").alias("n_new"))


_CUT = "SELECT conv_id, i, trim(s) AS sentence, o FROM (SELECT conv_id, i, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS o FROM {0}) WHERE trim(s) <> ''"
_NTH = "row_number() OVER (PARTITION BY conv_id, i, sentence ORDER BY o) AS n"


@query(f"""WITH cur AS (SELECT conv_id, turn AS i, text FROM conversations WHERE text IS NOT NULL), old AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN turn + 100 ELSE turn END AS i, CASE WHEN turn % 2 = 1 THEN 'Neu dazu. ' || text ELSE text END AS text FROM conversations WHERE text IS NOT NULL),
bi AS (SELECT cur.conv_id, cur.i, old.i AS j FROM cur JOIN old USING (conv_id, i)), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY i) AS n FROM cur WHERE (conv_id, i) NOT IN (SELECT (conv_id, i) FROM bi)),
r AS (SELECT conv_id, text, i AS j, row_number() OVER (PARTITION BY conv_id, text ORDER BY i) AS n FROM old), m AS (SELECT * FROM bi UNION ALL SELECT l.conv_id, l.i, r.j FROM l JOIN r USING (conv_id, text, n)),
cs AS (SELECT *, {_NTH} FROM ({_CUT.format('cur')})), os AS (SELECT conv_id, i AS j, sentence, {_NTH} FROM ({_CUT.format('old')}))
SELECT cs.conv_id, count(*) AS n_sentences, count(os.n) AS n_reused, count(*) FILTER (WHERE os.n IS NOT NULL AND m.j <> m.i) AS n_moved FROM cs LEFT JOIN m ON m.conv_id = cs.conv_id AND m.i = cs.i LEFT JOIN os ON os.conv_id = m.conv_id AND os.j = m.j AND os.sentence = cs.sentence AND os.n = cs.n GROUP BY 1""")
def sentence_cache_reuse(t):
    """Sentences whose flags an earlier report of the same conversations has: in it a third of the conversations stood elsewhere, and every second turn had a sentence more."""
    current = t.conversations.where("text is not null").select("conv_id", F.col("turn").alias("i"), "text")
    moved, more = F.when(F.col("conv_id") % 3 == 0, F.col("i") + 100).otherwise(F.col("i")), F.when(F.col("i") % 2 == 1, F.concat(F.lit("Neu dazu. "), "text")).otherwise(F.col("text"))
    previous = current.select("conv_id", moved.alias("i"), more.alias("text"))
    cut = lambda rows: rows.select("conv_id", "i", F.posexplode(F.split("text", r"\. ")).alias("ordinal", "s")).select("conv_id", "i", "ordinal", F.trim("s").alias("sentence")).where("sentence != ''")
    same = citations.same_paragraphs(current, previous, "conv_id", "i", "text")
    paragraph = F.struct("conv_id", F.col("previous_index").alias("i"))
    now = cut(current).join(same, ["conv_id", "i"], "left").withColumn("paragraph", F.when(F.col("previous_index").isNotNull(), paragraph))
    before = cut(previous).select(F.struct("conv_id", "i").alias("paragraph"), "sentence", "ordinal", F.lit(True).alias("flag"))
    found = citations.reused(now, before, "paragraph", "sentence", "flag")
    return found.groupBy("conv_id").agg(F.count("*").alias("n_sentences"), F.count_if(~F.col("is_new")).alias("n_reused"), F.count_if(~F.col("is_new") & (F.col("i") != F.col("previous_index"))).alias("n_moved"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS paragraph_text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def conversation_paragraphs(t):
    return citations.paragraphs(t.conversations.where("role = 'assistant'"), "conv_id", "turn", "text")


@query("SELECT o_orderkey, ' [vgl. @K' || o_custkey || ', pp. ' || o_orderkey || ']' AS citation FROM orders")
def citation_markup(t):
    return t.orders.select("o_orderkey", citations.markup(F.concat(F.lit("K"), "o_custkey"), F.concat(F.lit("vgl. "), "o_orderkey")).alias("citation"))


@query(HITS + "SELECT label, grp, source, CAST(sum(cnt) AS BIGINT) AS n FROM hits WHERE contains(lower(grp), 'work') AND (contains(lower(label), 'th') OR levenshtein(lower(label), 'th') <= 1) AND contains(lower(source), 'src1') GROUP BY ALL")
def report_search(t):
    rows = report.search(hits(t, "source"), "group:work label:th file:src1", {"group": "grp", "label": "label", "file": "source"}, fuzzy_label=True)
    return rows.groupBy("label", "grp", "source").agg(F.sum("cnt").alias("n"))


@query(r"SELECT DISTINCT doc_id, unnest(list_filter(string_split(translate(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'), 'uj', 'vi'), ' '), lambda x: x <> '')) AS token FROM documents")
def report_inverted_index(t):
    return report.inverted_index(t.documents, "doc_id", "text")


_WORD_MAP = {"und": "vnd", "the": "ye", "les": "ces"}


def _case(table: dict[str, str]) -> str:
    return "CASE lower(x) " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in table.items()) + " END"


def _replaced(column: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query(rf"""WITH a AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_replaced("text", T.MODERN_LETTERS)}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: coalesce({_case(T.MODERN_WORDS)}, x)), '') AS text FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), lambda x: CASE WHEN {_case(_WORD_MAP)} IS NULL THEN x WHEN x = upper(x) THEN upper({_case(_WORD_MAP)}) WHEN x[1] = upper(x[1]) THEN upper({_case(_WORD_MAP)}[1]) || {_case(_WORD_MAP)}[2:] ELSE {_case(_WORD_MAP)} END), '') AS text FROM a""")
def modernized_documents(t):
    table = _WORD_MAP
    return t.documents.select("doc_id", T.modernize_words(T.modernize_letters(F.col("text")), table).alias("text"))


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents WHERE lang = 'fr'")
def folded_french(t):
    return t.documents.where("lang = 'fr'").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(r"SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def connections_per_user(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view'")
def rowset_union(t):
    u = lambda k: t.events.where(F.col("event_type") == k).select("user_id")
    return u("click").union(u("view")).distinct()


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE value > 50")
def rowset_intersect(t):
    return t.events.where("event_type = 'click'").select("user_id").intersect(t.events.where("value > 50").select("user_id"))


@query("SELECT CAST(floor(value) AS BIGINT) AS whole FROM events WHERE event_type = 'click' EXCEPT SELECT CAST(floor(value) AS BIGINT) FROM events WHERE event_type = 'purchase'")
def rowset_difference(t):
    of = lambda k: t.events.where(F.col("event_type") == k).select(F.floor("value").alias("whole"))
    return of("click").subtract(of("purchase"))


@query(HITS + ", m AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, label) AS n FROM hits) SELECT doc_id, label AS main_label FROM m WHERE n = 1")
def main_label_per_document(t):
    own = Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "label")
    return hits(t).withColumn("n", F.row_number().over(own)).where("n = 1").select("doc_id", F.col("label").alias("main_label"))


@query(r"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN '"' || text || '"; ' || chr(10) || '"Ende"' ELSE text END, '^\s+|\s+$', '', 'g') AS notizen FROM conversations WHERE text IS NOT NULL""")
def csv_round_trip(t):
    """Turns written as CSV with quotes, delimiters and line breaks in their fields, and read back in splits."""
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("„"), "text", F.lit('“; \n"Ende"'))).otherwise(F.col("text"))
    folder = new_folder(t.spark, "csv")
    plain = F.translate(text, "„“", '""')
    t.conversations.where("text is not null").select("conv_id", "turn", plain.alias("Notizen")).write.csv(folder, sep=";", header=True, quoteAll=True, escape='"', lineSep="\n")
    return files.sanitized_csv(t.spark, folder, split=1 << 20)
