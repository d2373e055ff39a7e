"""Queries on the catalogue and on matching: works are parts, acquisitions are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import new_folder, written
from ..operators import catalog, fuzzy, ordered, resolve, setjoin
from ..sinks import versions
from .registry import Tables, query

WORKS = "WITH works AS (SELECT p_partkey AS id, p_brand AS author, p_name AS title, p_size AS year, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS oa, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS file_exists, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS owned, p_type AS title_key FROM part)\n"
ACQ = "acq AS (SELECT o_orderkey AS id, 1 + o_custkey % (SELECT count(*) FROM part) AS work_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders)\n"


def works(t: Tables):
    bit = lambda n: (F.col("p_size") % n == 0).cast("int")
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("author"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), bit(3).alias("oa"), bit(2).alias("file_exists"), bit(2).alias("owned"), F.col("p_type").alias("title_key"))


def acquisitions(t: Tables):
    n = t.part.count()
    return t.orders.select(F.col("o_orderkey").alias("id"), (1 + F.col("o_custkey") % n).alias("work_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


@query(WORKS + ", " + ACQ + "SELECT id, author, title, (SELECT count(*) FROM acq WHERE work_id = works.id AND status <> 'F') AS open_acq FROM works")
def works_with_open_acq(t):
    return catalog.with_open_acquisitions(works(t), acquisitions(t), ("F",)).select("id", "author", "title", "open_acq")


@query(WORKS + ", " + ACQ + "SELECT acq.id, work_id, status, priority, title FROM acq LEFT JOIN works ON works.id = work_id ORDER BY status, priority, acq.id LIMIT 200")
def acquisitions_sorted_top(t):
    joined = acquisitions(t).join(works(t).select(F.col("id").alias("work_id"), "title"), "work_id", "left")
    return catalog.library_sorted(joined, ("status", True), ("priority", True), ("id", True)).limit(200).select("id", "work_id", "status", "priority", "title")


@query("SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def acq_status_matrix(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])


@query(WORKS + "SELECT count(*) AS n_works, count(*) FILTER (WHERE file_exists = 1) AS n_have, count(*) FILTER (WHERE file_exists = 0) AS n_missing FROM works")
def catalog_summary(t):
    return catalog.summary(works(t))


@query(WORKS + "SELECT id, title, CASE WHEN oa = 1 THEN 'download' ELSE 'scan_request' END AS action FROM works WHERE file_exists = 0")
def missing_export(t):
    return catalog.missing_export(works(t)).select("id", "title", "action")


@query(WORKS + "SELECT id, author, title FROM works WHERE owned = 1 AND oa = 1 AND (contains(lower(author), 'brand#1') OR contains(lower(title), 'brand#1'))")
def works_filter_search(t):
    return catalog.filtered(works(t), owned=True, oa=True, needle="Brand#1").select("id", "author", "title")


@query(WORKS + "SELECT author, title_key, year, count(*) AS c, min(id) AS keep_id FROM works GROUP BY ALL HAVING count(*) > 1")
def dedupe_groups(t):
    return catalog.duplicate_groups(works(t), "author", "title_key", "year")


@query(WORKS + "SELECT id, author, title_key, year FROM works WHERE id IN (SELECT min(id) FROM works GROUP BY author, title_key, year)")
def dedupe_keep_first(t):
    return catalog.dedupe(works(t), {}, "author", "title_key", "year")[0].select("id", "author", "title_key", "year")


@query(WORKS + ", m AS (SELECT id AS old_id, min(id) OVER (PARTITION BY author, title_key, year) AS keep_id FROM works) SELECT keep_id AS work_id, count(*) AS n FROM lineitem JOIN m ON l_partkey = old_id GROUP BY 1")
def dedupe_repoint(t):
    child = t.lineitem.select(F.col("l_partkey").alias("work_id"))
    moved = catalog.dedupe(works(t), {"lines": child}, "author", "title_key", "year")[1]["lines"]
    return moved.groupBy("work_id").agg(F.count("*").alias("n"))


@query(WORKS + """, old AS (SELECT * FROM works WHERE id % 2 = 0), fresh AS (SELECT * FROM works WHERE id % 2 = 1), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author, title_key, year ORDER BY id DESC) AS n FROM fresh) WHERE n = 1)
SELECT coalesce(o.id, k.id) AS id, coalesce(o.author, k.author) AS author, coalesce(o.title_key, k.title_key) AS title_key, coalesce(o.year, k.year) AS year, coalesce(k.title, o.title) AS title, coalesce(k.oa, o.oa) AS oa
FROM old o FULL JOIN k ON o.author = k.author AND o.title_key = k.title_key AND o.year = k.year""")
def upsert_works(t):
    w = works(t)
    out = catalog.upsert(w.where("id % 2 = 0"), w.where("id % 2 = 1"), ("author", "title_key", "year"), ("title",))
    return out.select("id", "author", "title_key", "year", "title", "oa")


@query(WORKS + "SELECT author, count(*) AS n FROM (SELECT author FROM works WHERE id % 2 = 0 UNION ALL SELECT author FROM (SELECT DISTINCT author, title FROM works WHERE id % 2 = 1) f WHERE NOT EXISTS (SELECT 1 FROM works o WHERE o.id % 2 = 0 AND o.author = f.author AND o.title = f.title)) GROUP BY author")
def insert_ignore(t):
    w = works(t)
    return catalog.insert_or_ignore(w.where("id % 2 = 0"), w.where("id % 2 = 1"), "author", "title").groupBy("author").agg(F.count("*").alias("n"))


@query(WORKS + """, old AS (SELECT * FROM works WHERE id % 3 = 0), n AS (SELECT * FROM works WHERE id % 3 = 1), k AS (SELECT author, title, max(id) AS id, max_by(year, id) AS year FROM n GROUP BY author, title),
o AS (SELECT author, title, min(id) AS id, max_by(year, id) AS year FROM old GROUP BY author, title), u AS (SELECT coalesce(o.author, k.author) AS author, coalesce(o.title, k.title) AS title, coalesce(o.id, k.id) AS id, coalesce(k.year, o.year) AS year FROM o FULL JOIN k ON o.author = k.author AND o.title = k.title),
i AS (SELECT author, title, min(id) AS id, max_by(year, id) AS year FROM works WHERE id % 3 = 2 GROUP BY author, title) SELECT author, title, id, year, 3 AS version FROM u UNION ALL SELECT author, title, id, year, 3 FROM i WHERE (author, title) NOT IN (SELECT (author, title) FROM u)""".replace("\n, old", ", old"))
def works_written_back(t):
    """A table of works in three versions: built, upserted twice by the same run, and completed by another; read back."""
    w = works(t).select("id", "author", "title", "year")
    some = lambda k: w.where(F.col("id") % 3 == k)
    one = lambda rows: rows.groupBy("author", "title").agg(F.min("id").alias("id"), F.max_by("year", "id").alias("year")).select("id", "author", "title", "year")
    folder = new_folder(t.spark, "works")
    versions.rebuilt(t.spark, folder, one(some(0)))
    for _ in range(2):
        versions.upsert(t.spark, folder, some(1), ("author", "title"), run="second")
    last = versions.insert_or_ignore(t.spark, folder, one(some(2)), "author", "title", run="third")
    return versions.read(t.spark, folder).select("author", "title", "id", "year").withColumn("version", F.lit(last.number))


@query("SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey FROM supplier")
def surrogate_ids(t):
    old = t.nation.select(F.col("n_nationkey").alias("id"))
    return catalog.with_new_ids(old, t.supplier.select("s_suppkey"), ["s_suppkey"])


@query(WORKS + ", " + ACQ + "SELECT 'work' AS kind, id, CAST(NULL AS BIGINT) AS work_id FROM works WHERE id % 10 <> 0 UNION ALL SELECT 'acquisition', id, work_id FROM acq WHERE work_id % 10 <> 0")
def cascade_delete(t):
    """Every tenth work goes, and its acquisitions with it."""
    w, a = works(t), acquisitions(t)
    left, acq = catalog.cascade_delete(w.where("id % 10 = 0"), w, a)
    return left.select(F.lit("work").alias("kind"), "id", F.lit(None).cast("long").alias("work_id")).union(acq.select(F.lit("acquisition"), "id", "work_id"))


@query("SELECT p_partkey AS id, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS file_exists, n AS file_size, CASE WHEN n IS NULL THEN NULL WHEN has_a THEN '.pdf' ELSE '.txt' END AS file_ext FROM part LEFT JOIN (SELECT l_partkey, coalesce(max(l_orderkey) FILTER (WHERE l_returnflag = 'A'), max(l_orderkey)) AS n, bool_or(l_returnflag = 'A') AS has_a FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1) ON p_partkey = l_partkey")
def library_sync_flags(t):
    ext = F.when(F.col("l_returnflag") == "A", ".pdf").otherwise(".txt")
    listing = t.lineitem.where("l_returnflag in ('A', 'N')").groupBy(F.col("l_partkey").cast("string").alias("stub"), ext.alias("ext")).agg(F.max("l_orderkey").alias("size")).withColumn("path", F.col("stub"))
    base = works(t).withColumns({"file_stub": F.col("id").cast("string"), "file_ext": F.lit(None), "file_size": F.lit(None), "file_path": F.lit(None)})
    return catalog.sync_library(base, listing).select("id", "file_exists", "file_size", "file_ext")


@query("SELECT p_type, count(*) AS n, strip_accents(lower(min(p_name))) AS first_key FROM part GROUP BY p_type")
def normalized_names(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_name").alias("m")).select("p_type", "n", T.normalize(F.col("m")).alias("first_key"))


@query("SELECT c_custkey, trim(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9]+', ' ', 'g')) AS ckey, trim(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def canonical_keys_and_slugs(t):
    return t.customer.select("c_custkey", T.canonical_key(F.col("c_name")).alias("ckey"), T.slugify(F.col("c_name")).alias("slug"))


_TOKENS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))"
OVERLAP = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS tk FROM documents), b AS (SELECT item_id AS entity, {_TOKENS} AS tk FROM benchmark),
o AS (SELECT doc_id, entity, nl, nr, count(*) AS shared FROM (SELECT doc_id, len(tk) AS nl, unnest(tk) AS token FROM d) JOIN (SELECT entity, len(tk) AS nr, unnest(tk) AS token FROM b) USING (token) GROUP BY ALL)
"""


def pairs(t: Tables, jaccard: bool):
    """Documents are far longer than the items, which are few: they are compared by all their words at once, which is exact without rounds."""
    return setjoin.best_pairs(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", jaccard=jaccard, bars=(), stopwords=())


@query(OVERLAP + "SELECT doc_id, entity, confidence FROM (SELECT doc_id, entity, round(shared / (nl + nr - shared), 4) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY round(shared / (nl + nr - shared), 4) DESC, entity) AS n FROM o) WHERE n = 1")
def jaccard_best_match(t):
    return resolve.jaccard_best(pairs(t, True), "doc_id")


@query(OVERLAP + "SELECT doc_id, min(entity) AS entity, shared FROM (SELECT *, max(shared) OVER (PARTITION BY doc_id) AS m FROM o) WHERE shared = m GROUP BY doc_id, shared HAVING count(*) = 1")
def unique_token_winner(t):
    return resolve.unique_winner(pairs(t, False), "doc_id")


_KEY = r"trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'))"


@query(OVERLAP.replace("FROM documents)", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text || ' !' FROM benchmark))") + f""", kd AS (SELECT doc_id, {_KEY} AS k FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text || ' !' FROM benchmark)), kb AS (SELECT item_id AS entity, {_KEY} AS k FROM benchmark),
c AS (SELECT doc_id, entity, 1.0 AS score, 0 AS step FROM kd JOIN kb USING (k) WHERE k <> '' UNION ALL SELECT doc_id, entity, CAST(shared AS DOUBLE), 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, entity) AS n FROM o) WHERE n = 1)
SELECT doc_id, entity, step, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step, score DESC, entity) AS n FROM c) WHERE n = 1""")
def resolve_waterfall(t):
    """Documents, and the items themselves with a mark after them: an equal key first, else most shared words."""
    left = t.documents.select("doc_id", "text").union(t.benchmark.select(-1 - F.col("item_id"), F.concat("text", F.lit(" !"))))
    return resolve.key_or_overlap(left, "doc_id", "text", t.benchmark, "item_id", "text")


_TITLE = r"array_to_string(list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: x <> '')[1:8], ' ')"


@query(f"""WITH d AS (SELECT doc_id, {_TITLE} AS k FROM documents WHERE text IS NOT NULL), r AS (SELECT min(doc_id) AS entity, k FROM d WHERE k <> '' GROUP BY k),
l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'neue ausgabe ' || k ELSE k END AS k FROM d WHERE k <> ''),
lt AS (SELECT doc_id, k, list_distinct(list_filter(string_split(k, ' '), lambda x: length(x) >= 3)) AS tk FROM l), rt AS (SELECT entity, list_distinct(list_filter(string_split(k, ' '), lambda x: length(x) >= 3)) AS tk FROM r),
o AS (SELECT doc_id, entity, count(*) / (nl + nr - count(*)) AS j FROM (SELECT doc_id, len(tk) AS nl, unnest(tk) AS w FROM lt) JOIN (SELECT entity, len(tk) AS nr, unnest(tk) AS w FROM rt) USING (w) GROUP BY doc_id, entity, nl, nr),
c AS (SELECT doc_id, entity, 0 AS step, CAST(1 AS DOUBLE) AS s FROM l JOIN r USING (k) UNION ALL SELECT doc_id, entity, 1, round(j, 4) FROM o)
SELECT doc_id, entity, step, s AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step, s DESC, entity) AS n FROM c) WHERE n = 1""")
def works_bound_by_key_or_words(t):
    """Titles (a document's first eight words) to the different titles of all documents: two thirds have an equal key, a third has other words before."""
    own = F.array_join(F.slice(F.filter(F.split(T.canonical_key(F.col("text")), " "), lambda w: w != ""), 1, 8), " ")
    d = written(t.documents.where("text is not null").select("doc_id", own.alias("title")).where("title != ''"), "titles")
    right = d.groupBy("title").agg(F.min("doc_id").alias("entity"))
    left = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("neue ausgabe "), "title")).otherwise(F.col("title")).alias("title"))
    return resolve.key_or_words(left, "doc_id", "title", right, "entity", "title")


@query()
def fuzzy_catalogue_match(t):
    return fuzzy.best_matches(t.supplier, "s_suppkey", "s_name", t.customer, "c_custkey", "c_name")


@query()
def greedy_assignment(t):
    scores = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    return resolve.greedy_one_to_one(scores, "l_suppkey", "l_partkey")


@query()
def first_come_assignment(t):
    """Suppliers in order of their keys, each with the part that it sold most of among those that none before has taken."""
    sold = t.lineitem.groupBy("l_suppkey", "l_partkey").agg((-F.sum("l_quantity")).alias("p")).withColumn("o", F.col("l_suppkey"))
    return ordered.first_come(sold, "l_suppkey", "l_partkey", "o", "p")


@query()
def near_duplicate_terms(t):
    """Names of parts with their brands, in order of first use, without those too like one kept before."""
    names = t.part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("term")).agg(F.min("p_partkey").alias("first_id"))
    return ordered.leaders(names, "first_id", "term")


@query("SELECT s_suppkey AS id, s_name AS name, coalesce(n_name, s_name) AS label FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey IN (1, 2)")
def chronik_nodes_label(t):
    n = t.nation.where("n_regionkey in (1, 2)").select("n_nationkey", "n_name")
    return t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.coalesce("n_name", "s_name").alias("label"))


@query("SELECT p_brand AS brand, s_nationkey AS nation, o_orderpriority AS run, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def chronik_werk_intensity(t):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("run"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return li.join(o, "l_orderkey").join(p, "l_partkey").join(s, "l_suppkey").groupBy("brand", "nation", "run").agg(F.count("*").alias("weight"))
