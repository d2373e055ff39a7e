"""Queries on files, authors and acquisitions: waterfalls over several keys, triage, stubs, decorated edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import catalog, mentions, resolve
from .registry import query


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')) || '__' || s_suppkey AS file_stub FROM supplier WHERE s_suppkey % 3 <> 0")
def file_stubs(t):
    """Stubs that differ from those there already."""
    stub = F.concat(T.slugify(F.col("s_name")), F.lit("__"), "s_suppkey")
    old = F.when(F.col("s_suppkey") % 3 == 0, stub)
    return t.supplier.where(~stub.eqNullSafe(old)).select("s_suppkey", stub.alias("file_stub"))


@query("""WITH f AS (SELECT s_suppkey AS id, s_name || '.pdf' AS name, s_acctbal > 0 AS has_text, s_suppkey % 4 = 0 AS err FROM supplier), z AS (SELECT 'supplier#' || lpad(CAST(2 * c_custkey AS VARCHAR), 9, '0') || '.pdf' AS name, c_custkey FROM customer),
m AS (SELECT f.*, (SELECT count(*) FROM z WHERE z.name = lower(f.name)) AS items FROM f)
SELECT CASE WHEN err THEN 'error' WHEN NOT has_text THEN 'needs_ocr' WHEN items = 0 THEN 'not_in_library' ELSE 'in_library' END AS state, count(*) AS n FROM m GROUP BY 1""")
def ocr_triage(t):
    f = t.supplier.select(F.lower(F.concat("s_name", F.lit(".pdf"))).alias("name"), (F.col("s_acctbal") > 0).alias("has_text"), (F.col("s_suppkey") % 4 == 0).alias("err"))
    z = t.customer.select(F.concat(F.lit("supplier#"), F.lpad((2 * F.col("c_custkey")).cast("string"), 9, "0"), F.lit(".pdf")).alias("name"), "c_custkey")
    items = z.groupBy("name").agg(F.sort_array(F.collect_list("c_custkey")).alias("items"))
    state = F.when(F.col("err"), "error").when(~F.col("has_text"), "needs_ocr").when(F.col("items").isNull(), "not_in_library").otherwise("in_library")
    return f.join(items, "name", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT src, tgt, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name ELSE CAST(src AS VARCHAR) END AS src_label, coalesce(s_name, CAST(tgt AS VARCHAR)) AS tgt_label FROM (SELECT DISTINCT o_custkey AS src, l_suppkey AS tgt FROM lineitem JOIN orders ON o_orderkey = l_orderkey) LEFT JOIN customer ON c_custkey = src LEFT JOIN supplier ON s_suppkey = tgt")
def decorated_edges(t):
    e = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("tgt")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src")), "l_orderkey").select("src", "tgt").distinct()
    named = e.join(t.customer.select(F.col("c_custkey").alias("src"), F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_name")).alias("c_name")), "src", "left").join(t.supplier.select(F.col("s_suppkey").alias("tgt"), "s_name"), "tgt", "left")
    return named.select("src", "tgt", F.coalesce("c_name", F.col("src").cast("string")).alias("src_label"), F.coalesce("s_name", F.col("tgt").cast("string")).alias("tgt_label"))


_ITEMS = """d AS (SELECT s_suppkey AS id, '/lib/' || s_name || '.pdf' AS path, s_name || '.pdf' AS name, s_name AS stem, sha1(s_name) AS sha FROM supplier),
i AS (SELECT id AS entity, CASE id % 6 WHEN 0 THEN upper(path) WHEN 1 THEN '/old/' || name || '.bak' END AS ipath, CASE id % 6 WHEN 2 THEN sha END AS isha, CASE id % 6 WHEN 3 THEN upper(name) WHEN 4 THEN lower(stem) WHEN 0 THEN name END AS iname FROM d)"""


@query(f"""WITH {_ITEMS}, c AS (SELECT d.id, entity, 0 AS step FROM d JOIN i ON lower(ipath) = lower(path) UNION ALL SELECT d.id, entity, 1 FROM d JOIN i ON contains(lower(ipath), lower(name)) UNION ALL
SELECT d.id, entity, 2 FROM d JOIN i ON isha = sha UNION ALL SELECT d.id, entity, 3 FROM d JOIN i ON lower(iname) = lower(name) UNION ALL SELECT d.id, entity, 4 FROM d JOIN i ON lower(iname) = lower(stem))
SELECT id, entity, step FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, entity) AS n FROM c) WHERE n = 1""")
def foreign_waterfall(t):
    """Files to a foreign library: by path, by a path that holds the file's name, by hash, by name, by name without ending; a sixth each, and a sixth is not there."""
    d = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/lib/"), "s_name", F.lit(".pdf")).alias("path"), F.sha1("s_name").alias("sha"))
    k, name, stem = F.col("id") % 6, F.element_at(F.split("path", "/"), -1), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    items = d.select(
        F.col("id").alias("entity"), F.when(k == 0, F.upper("path")).when(k == 1, F.concat(F.lit("/old/"), name, F.lit(".bak"))).alias("path"),
        F.when(k == 2, F.col("sha")).alias("sha"), F.when(k == 3, F.upper(name)).when(k == 4, F.lower(stem)).when(k == 0, name).alias("name"),
    )
    return resolve.foreign_items(d, items).select("id", "entity", "step")


@query("SELECT o_custkey AS work_id, o_orderpriority AS action, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS id FROM orders GROUP BY ALL")
def acquisitions_upsert(t):
    """Of equal (work, action) the later order counts; half the table is there before the other half comes."""
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("work_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("status"))
    middle = a.agg(F.expr("percentile_approx(id, 0.5)").alias("m"))
    halves = a.crossJoin(F.broadcast(middle))
    old = catalog.upsert(a.limit(0), halves.where("id <= m").select(*a.columns), ("work_id", "action"), ())
    new = catalog.upsert(a.limit(0), halves.where("id > m").select(*a.columns), ("work_id", "action"), ())
    joined = catalog.upsert(old.withColumn("last", F.col("id")), new.withColumn("last", F.col("id")), ("work_id", "action"), ())
    return joined.select("work_id", "action", "status", F.col("last").alias("id"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(['elle', 'keit', 'tion']) AS s, lower(strip_accents(text)) AS f FROM documents) WHERE contains(f, s) GROUP BY doc_id")
def surname_prefilter(t):
    """How many of three names the folded page holds, for pages that hold any."""
    names = F.array(*map(F.lit, ("elle", "keit", "tion")))
    folded = t.documents.select("doc_id", T.casefold(T.fold(F.col("text"))).alias("f"))
    held = folded.where(P.surname_on_page(F.col("f"), names))
    return held.select("doc_id", F.size(F.filter(names, lambda s: F.contains(F.col("f"), s))).cast("long").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 7 WHEN s_nationkey < 10 THEN 2 END AS author_id FROM supplier")
def author_of_file(t):
    """The first author whose alias a file name matches, after merging; the name carries the nation."""
    found = t.supplier.select("s_suppkey", F.concat(F.lit("doc_n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("_x.pdf")).alias("name"))
    aliases = t.spark.createDataFrame([(0, 1, 7, r"_n0[0-4]_"), (1, 2, None, r"_n0\d_")], "ordinal int, author_id int, merge_into int, alias string")
    return mentions.first_by_filename(found, aliases).select("s_suppkey", "author_id")


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS present FROM orders GROUP BY 1")
def presence_counts(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("present"))


@query("SELECT l_suppkey AS label, l_orderkey AS doc, l_linenumber AS page FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 12")
def label_examples_first12(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("label"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    return mentions.sampled(rows, ["label"], ["doc", "page"], 12)


@query("SELECT p_partkey, p_brand || ', ' || p_name || ', ' || p_size AS line, regexp_extract(p_name, '[^ #]+$') AS last FROM part")
def citation_lines(t):
    return t.part.select("p_partkey", T.citation_line(F.col("p_brand"), F.lit(""), F.col("p_name"), F.lit(None).cast("string"), F.col("p_size").cast("string")).alias("line"), F.regexp_extract("p_name", "[^ #]+$", 0).alias("last"))


@query("""WITH old AS (SELECT n_nationkey AS id, n_name AS name FROM nation), n AS (SELECT DISTINCT name FROM (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT p_type FROM part)),
made AS (SELECT name, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY name) AS id FROM n WHERE name NOT IN (SELECT name FROM old)) SELECT name, id, false AS is_new FROM old UNION ALL SELECT name, id, true FROM made""")
def get_or_create_authors(t):
    """Names that a run has, with the ids of those that the table has, and new ids after them for the others."""
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    named = t.customer.select(F.col("c_mktsegment").alias("name")).union(t.nation.where("n_regionkey = 1").select("n_name")).union(t.part.select("p_type"))
    return catalog.get_or_create(old, named, "name").select("name", "id", "is_new")
