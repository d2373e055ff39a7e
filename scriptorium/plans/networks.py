"""Queries on edges, similarity and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import written
from ..operators import edges as E
from ..operators import network, similarity
from .mentions import HITS, hits
from .registry import Tables, query

EDGES = "WITH e AS (SELECT o_custkey AS src, l_suppkey AS tgt, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS bib_hits FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)\n"


def cited(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("tgt"), "l_returnflag").join(o, "l_orderkey")


def author_edge_table(t: Tables):
    return E.citation_edges(cited(t), "src", "tgt", F.col("l_returnflag") == "R")


@query(EDGES + "SELECT src, tgt, total, bib_hits, total - bib_hits AS text_hits, total + bib_hits AS weighted FROM e")
def author_edges(t):
    return author_edge_table(t)


@query("SELECT l_suppkey AS tgt, l_returnflag AS flag, string_agg(ctx, ' | ' ORDER BY n) AS examples FROM (SELECT l_suppkey, l_returnflag, l_orderkey || ':' || l_linenumber AS ctx, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3 GROUP BY ALL")
def author_edge_examples_first3(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("tgt"), F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber")
    return E.citation_edges(rows, "tgt", "flag", F.lit(False), example=F.concat_ws(":", "l_orderkey", "l_linenumber"), order=["l_orderkey", "l_linenumber"]).select("tgt", "flag", "examples")


@query(EDGES + "SELECT c_name AS label, CAST(sum(total + bib_hits) AS BIGINT) AS weighted FROM e JOIN customer ON c_custkey = src GROUP BY c_name ORDER BY weighted DESC, label LIMIT 10")
def top_citers(t):
    named = author_edge_table(t).groupBy("src").agg(F.sum("weighted").alias("weighted")).join(t.customer.select(F.col("c_custkey").alias("src"), F.col("c_name").alias("label")), "src")
    return network.top(named.groupBy("label").agg(F.sum("weighted").alias("weighted")), 10, F.desc("weighted"), "label")


@query(EDGES + "SELECT s_name AS label, CAST(sum(total + bib_hits) AS BIGINT) AS weighted FROM e JOIN supplier ON s_suppkey = tgt GROUP BY s_name ORDER BY weighted DESC, label LIMIT 10")
def top_cited(t):
    named = author_edge_table(t).groupBy("tgt").agg(F.sum("weighted").alias("weighted")).join(t.supplier.select(F.col("s_suppkey").alias("tgt"), F.col("s_name").alias("label")), "tgt")
    return network.top(named.groupBy("label").agg(F.sum("weighted").alias("weighted")), 10, F.desc("weighted"), "label")


_EXAMPLE = "CASE WHEN l_linenumber % 2 = 0 THEN repeat('beleg ' || l_orderkey || ' ', CAST(l_suppkey % 50 AS INTEGER)) ELSE '' END"


@query(f"""WITH e AS (SELECT lower(p_type) AS u, regexp_extract(p_name, '[^ ]+$') AS v, CAST(l_quantity AS BIGINT) AS w, l_orderkey * 10 + l_linenumber AS o, {_EXAMPLE} AS x FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT u, v, sum(w)::BIGINT AS weight, coalesce(arg_min(x, lpad(CAST(o AS VARCHAR), 15, '0') || x) FILTER (x <> ''), '') AS x FROM e WHERE u <> v GROUP BY u, v) SELECT u, v, weight, CASE WHEN length(x) > 220 THEN left(x, 220) || '…' ELSE x END AS example FROM g""")
def author_family_edges(t):
    """Families of cited and citing names with the first example that isn't empty: parts' types are cited by their names."""
    own = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.concat_ws(" ", "p_brand", "p_type").alias("tgt"), F.col("p_name").alias("src"), "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.expr("repeat(concat('beleg ', l_orderkey, ' '), cast(l_suppkey % 50 as int))")).otherwise("")
    return E.author_families(own, F.col("l_quantity").cast("long"), example=text, order=["l_orderkey", "l_linenumber"])


@query("SELECT l_suppkey AS u, l_partkey AS v, count(*) AS weight, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS raw_source FROM lineitem GROUP BY ALL")
def edges_with_last_pattern(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return E.counted_edges(rows, "u", "v", pattern="l_returnflag", order="ord")


@query("SELECT year(l_shipdate) AS run_id, count(DISTINCT (l_suppkey, l_partkey)) AS n_edges, count(*) AS n_hits FROM lineitem GROUP BY 1")
def edge_run_counts(t):
    pairs = t.lineitem.groupBy(F.year("l_shipdate").cast("long").alias("run_id"), "l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return pairs.groupBy("run_id").agg(F.count("*").alias("n_edges"), F.sum("n").alias("n_hits"))


_M = {
    "count": "CAST(count(*) AS DOUBLE)",
    "binary": "CAST(1 AS DOUBLE)",
    "intensity": "sum(l_quantity)",
}


def _pairs_sql(kind: str) -> str:
    m = f"WITH m0 AS (SELECT l_suppkey AS r, l_partkey AS c, {_M['count' if kind == 'tfidf' else kind]} AS w FROM lineitem GROUP BY ALL), "
    if kind == "tfidf":
        m += "rs AS (SELECT r, sum(w) AS s FROM m0 GROUP BY r), df AS (SELECT c, count(*) AS d FROM m0 GROUP BY c), m AS (SELECT m0.r, m0.c, m0.w / s * (ln((1 + (SELECT count(*) FROM rs)) / (1 + d)) + 1) AS w FROM m0 JOIN rs USING (r) JOIN df USING (c)), "
    else:
        m += "m AS (SELECT * FROM m0), "
    return m + "nm AS (SELECT r, sqrt(sum(w * w)) AS norm FROM m GROUP BY r), p AS (SELECT x.r AS a, y.r AS b, sum(x.w * y.w) AS dot, count(*) AS shared FROM m x JOIN m y ON x.c = y.c AND x.r < y.r GROUP BY ALL), pairs AS (SELECT a, b, round(dot / (na.norm * nb.norm), 6) AS similarity, shared FROM p JOIN nm na ON na.r = a JOIN nm nb ON nb.r = b)\n"


def similarity_matrix(t: Tables, kind: str):
    m = similarity.matrix(t.lineitem, "l_suppkey", "l_partkey", "count" if kind == "tfidf" else kind, F.col("l_quantity"))
    m = written(m, "matrix")
    return written(similarity.tf_idf(m), "weighted") if kind == "tfidf" else m


for _kind in ("count", "binary", "intensity", "tfidf"):
    query(_pairs_sql(_kind) + "SELECT a, b, similarity, shared FROM pairs", f"similarity_pairs_{_kind}")(lambda t, kind=_kind: similarity.cosine_pairs(similarity_matrix(t, kind)))


@query(_pairs_sql("count") + "SELECT a, b, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)) WHERE rank <= 5")
def similarity_neighbors_top5(t):
    return similarity.top_neighbours(similarity_matrix(t, "count"), 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(DISTINCT l_suppkey) AS n_rows, count(DISTINCT l_partkey) AS n_cols, count(DISTINCT (l_suppkey, l_partkey)) AS nnz, round(1 - count(DISTINCT (l_suppkey, l_partkey)) / (count(DISTINCT l_suppkey) * count(DISTINCT l_partkey)), 6) AS sparsity FROM lineitem")
def similarity_info(t):
    return similarity.info(similarity_matrix(t, "binary"))


# The combined network: authors are customers' and suppliers' nations, chronicles the labels of documents.
COMBINED = HITS + """, ml AS (SELECT doc_id, label AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, label) AS n FROM hits) WHERE n = 1),
chron AS (SELECT label AS u, v, CAST(sum(cnt) AS BIGINT) AS weight, 'chroniken' AS s FROM hits JOIN ml USING (doc_id) WHERE label <> v GROUP BY ALL),
nat AS (SELECT n_nationkey AS k, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS f FROM nation),
auth AS (SELECT b.f AS u, a.f AS v, count(*) AS weight, 'authors' AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nat a ON a.k = c_nationkey JOIN nat b ON b.k = s_nationkey WHERE a.f <> b.f GROUP BY ALL),
b AS (SELECT * FROM auth UNION ALL SELECT * FROM chron),
ends AS (SELECT u AS node, s FROM b UNION SELECT v, s FROM b), layer AS (SELECT node, CASE WHEN count(*) = 2 THEN 'both' WHEN max(s) = 'authors' THEN 'modern_author' ELSE 'chron_label' END AS layer FROM ends GROUP BY node),
tot AS (SELECT u, v, CAST(sum(weight) AS BIGINT) AS weight, string_agg(DISTINCT s, ',' ORDER BY s) AS source_type FROM b GROUP BY u, v),
ed AS (SELECT u, v, weight, CASE WHEN x.layer = 'modern_author' AND y.layer = 'modern_author' THEN 'AA' WHEN x.layer = 'chron_label' AND y.layer = 'chron_label' THEN 'CC' ELSE 'AC' END AS edge_type, source_type FROM tot JOIN layer x ON x.node = u JOIN layer y ON y.node = v)
"""


def combined(t: Tables):
    n = t.nation.select("n_nationkey", "n_name")
    cust = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src_key"), F.col("n_name").alias("src"))
    supp = t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("tgt_key"), F.col("n_name").alias("tgt"))
    totals = author_edge_table(t).select(F.col("src").alias("src_key"), F.col("tgt").alias("tgt_key"), "total")
    named = totals.join(cust, "src_key").join(supp, "tgt_key").groupBy("src", "tgt").agg(F.sum("total").alias("total"))
    family = lambda c: T.slugify(F.col(c), None)
    authors = named.select(family("tgt").alias("u"), family("src").alias("v"), F.col("total").alias("weight")).where("u != v").groupBy("u", "v").agg(F.sum("weight").alias("weight"))
    labels = E.label_families(written(hits(t), "hits"), "doc_id", "label", F.col("cnt"))
    return E.combined_network(written(authors, "authors"), written(labels, "labels"))


@query(COMBINED + "SELECT * FROM ed")
def combined_network_edges(t):
    return combined(t)[1]


@query(COMBINED + "SELECT node, layer, CAST(coalesce(i, 0) AS BIGINT) AS in_weight, CAST(coalesce(o, 0) AS BIGINT) AS out_weight FROM layer LEFT JOIN (SELECT v AS node, sum(weight) AS i FROM tot GROUP BY v) USING (node) LEFT JOIN (SELECT u AS node, sum(weight) AS o FROM tot GROUP BY u) USING (node)")
def combined_network_nodes(t):
    return combined(t)[0]


@query(COMBINED + ", f AS (SELECT * FROM ed WHERE weight >= 20 AND edge_type IN ('AA', 'CC')) SELECT DISTINCT node FROM (SELECT u AS node FROM f UNION ALL SELECT v FROM f)")
def network_filter_minweight_types(t):
    return network.visible_nodes(network.filtered(combined(t)[1], least=20, types=("AA", "CC")))


_BIP = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem"


@query("WITH e AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem), h1 AS (SELECT DISTINCT v AS node FROM e WHERE u = 's1'), h2 AS (SELECT DISTINCT u AS node FROM e WHERE v IN (SELECT node FROM h1) AND u <> 's1') SELECT 's1' AS node, CAST(0 AS INTEGER) AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def network_khop2(t):
    e = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("u"), F.concat(F.lit("p"), "l_partkey").alias("v")).distinct()
    return network.k_hop(e, t.spark.createDataFrame([("s1",)], "node string"), 2)


@query(f"WITH e AS ({_BIP}) SELECT p FROM e WHERE s IN (1, 2) GROUP BY p HAVING count(*) = 2")
def network_common_neighbors(t):
    return network.common_neighbours(t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "s", "p", [1, 2])


@query(f"WITH e AS ({_BIP}) SELECT DISTINCT p FROM e WHERE p NOT IN (SELECT p FROM e WHERE s IN (1, 2))")
def network_non_neighbors(t):
    return network.non_neighbours(t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "s", "p", [1, 2])


@query("WITH e AS (SELECT 's' || l_suppkey AS u, 'p' || l_partkey AS v, count(*) AS w FROM lineitem GROUP BY ALL) SELECT node, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT u AS node, w FROM e UNION ALL SELECT v, w FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def weighted_degree_top10(t):
    e = E.counted_edges(t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("u"), F.concat(F.lit("p"), "l_partkey").alias("v")), "u", "v")
    return network.top(network.weighted_degree(e), 10, F.desc("degree"), "node")


@query()
def edge_thinning_greedy(t):
    """Customers and suppliers are people of one numbering, so that a node may be either end."""
    return network.thinned(author_edge_table(t).select(F.col("src").alias("u"), F.col("tgt").alias("v"), F.col("weighted").alias("weight")))


_SWEEP = """{b}{i} AS (SELECT {b}, row_number() OVER (ORDER BY avg(place), {b}) AS place FROM e JOIN {a}{j} USING ({a}) GROUP BY {b})"""
_SWEEPS = ", ".join(_SWEEP.format(a=a, b=b, i=i, j=j) for a, b, i, j in (("s", "f", 1, 0), ("f", "s", 1, 1), ("s", "f", 2, 1), ("f", "s", 2, 2)))


@query(f"WITH e AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f FROM lineitem), s0 AS (SELECT s, row_number() OVER (ORDER BY s) AS place FROM (SELECT DISTINCT s FROM e)), {_SWEEPS} SELECT CAST(s AS VARCHAR) AS node, place FROM s2 UNION ALL SELECT f, place FROM f2")
def bipartite_layout(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")).distinct()
    lefts, rights = network.barycentre_order(pairs, "s", "f")
    return lefts.select(F.col("s").cast("string").alias("node"), "place").union(rights.select("f", "place"))


@query("SELECT l_suppkey AS node, round(1 + sqrt(greatest(1, count(DISTINCT l_partkey))), 6) AS mass FROM lineitem GROUP BY l_suppkey")
def node_masses(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(F.count_distinct("l_partkey").alias("n")).select("node", F.round(T.node_mass(F.col("n")), 6).alias("mass"))


@query("WITH e AS (SELECT l_suppkey AS u, l_partkey AS v, count(*) AS w FROM lineitem GROUP BY ALL), p AS (SELECT u, v FROM e WHERE w >= 2), n AS (SELECT u, v FROM e WHERE w >= 3) SELECT 'hide' AS change, u, v FROM (SELECT * FROM p EXCEPT SELECT * FROM n) UNION ALL SELECT 'show', u, v FROM (SELECT * FROM n EXCEPT SELECT * FROM p)")
def visibility_delta(t):
    e = E.counted_edges(t.lineitem.select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")), "u", "v")
    p, n = (e.where(F.col("weight") >= k).select("u", "v") for k in (2, 3))
    return p.subtract(n).select(F.lit("hide").alias("change"), "u", "v").union(n.subtract(p).select(F.lit("show"), "u", "v"))
