"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .clustering import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, clusters
from .decontamination import contamination
from .language import languages
from .minhash import near_duplicates
from .packing import pack
from .pages import main_texts
from .quality import quality
from .resharding import read_back, reshard
from .secrets import KINDS, LIVE, WIDELY, secrets
from .suffixes import repeated_passages
from .tokenfiles import read_tokens, write_tokens
from .tokens import tokenizer_path
from .toxicity import toxicity

#: The layout that the resharding query starts from: six shards by source.
OLD_SHARDS = 6


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), end_id=2)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(documents(spark, sf_dir), tokenizer_path(), end_id=1)
    return read_tokens(spark, folder)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = read_back(reshard(documents(spark, sf_dir), old))
    own = F.col("text").cast("binary")
    return placed.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(own).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("uid")


#: All runs of 50 words of all documents, by their text.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda s: {'s': s - 1, 'h': md5(array_to_string(w[s:s + 49], ' '))}), recursive := true) FROM d WHERE len(w) >= 50),
shared AS (SELECT h, min(doc_id) AS first_id FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, s, first_id FROM g JOIN shared USING (h)),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS begins FROM c),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM marked)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start, CAST(max(s) + 50 AS INTEGER) AS "end", CAST(max(s) + 50 - min(s) AS INTEGER) AS n_words, min(first_id) AS first_doc_id, doc_id = min(first_id) AS is_first
FROM runs GROUP BY doc_id, r
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir), repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("verdicts", lambda s: s["kind"] == kind)).cast("long")
    having = lambda verdict: F.size(F.filter("verdicts", lambda s: s["verdict"] == verdict)).cast("long")
    base = F.filter("verdicts", lambda s: s["kind"].isin(KINDS[:3]))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("verdicts")).alias("spans"),
        having(LIVE).alias("n_live"), having(WIDELY).alias("n_copied"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


#: All windows of an item's length that hold one of its shingles (others have similarity 0), by exact similarity; no fingerprints.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS m, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ix AS (SELECT item_id, w, m, k, unnest(range(1, m - k + 2)) AS j FROM i),
ishingle AS (SELECT item_id, m, k, j, array_to_string(w[j:j + k - 1], ' ') AS s FROM ix),
dx AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i)),
dshingle AS (SELECT doc_id, len(w) AS n, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM dx),
win AS (SELECT DISTINCT doc_id, m, k, unnest(range(greatest(0, p - 1 - m + k), greatest(0, least(p - 1, n - m)) + 1)) AS start FROM dshingle JOIN (SELECT DISTINCT m, k, s FROM ishingle) USING (k, s)),
wx AS (SELECT doc_id, m, k, start, array_to_string(w[start + x:start + x + k - 1], ' ') AS s FROM (SELECT win.*, d.w, unnest(range(1, least(m, len(w)) - k + 2)) AS x FROM win JOIN d USING (doc_id))),
wf AS (SELECT doc_id, m, start, list(DISTINCT s) AS f FROM wx GROUP BY ALL),
itf AS (SELECT item_id, m, list(DISTINCT s) AS g FROM ishingle GROUP BY ALL),
pairs AS (SELECT doc_id, item_id, m, start, f, g, list_intersect(f, g) AS common FROM wf JOIN itf USING (m)),
weighed AS (SELECT doc_id, item_id, m, start, list_sum(list_transform(common, lambda x: length(x))) AS b, list_sum(list_transform(f, lambda x: length(x))) AS x, list_sum(list_transform(g, lambda x: length(x))) AS y FROM pairs WHERE len(common) > 0),
alike AS (SELECT doc_id, item_id, m, start, CAST(b AS DOUBLE) / (x + y - b) AS similarity FROM weighed WHERE CAST(b AS DOUBLE) / (x + y - b) >= 0.8),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r, count(*) OVER (PARTITION BY doc_id, item_id) AS windows FROM alike)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(m AS INTEGER) AS length, similarity, windows FROM ranked WHERE r = 1
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir))


def op12_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars", "n_template", "n_named")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def _lloyd_sql() -> str:
    """Lloyd's rounds over all rows, one after another, without grouping equal vectors."""
    place = "SELECT * FROM (SELECT vec_id, u, r, v, j AS cluster, d AS distance, row_number() OVER (PARTITION BY u ORDER BY d, j) AS k FROM (SELECT x.*, c.j, list_sum(list_transform(list_zip(x.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM q x, c{0} c)) WHERE k = 1"
    parts = [
        f"e AS (SELECT vec_id, row_number() OVER () AS u, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"q AS MATERIALIZED (SELECT vec_id, u, sha256('3:' || vec_id) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE}::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM e)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r, v) - 1 AS j, v AS m FROM q WHERE vec_id IS NOT NULL ORDER BY r, v LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({place.format(i)})")
        parts.append(f"s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{i}) GROUP BY ALL)")
        parts.append(f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS m FROM (SELECT cluster, i, CAST(s AS BIGINT) AS s, n FROM s{i}) GROUP BY cluster)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m{i}.m, c.m) AS m FROM c{i} c LEFT JOIN m{i} ON m{i}.cluster = c.j)")
    parts.append(f"z AS MATERIALIZED ({place.format(ROUNDS)})")
    return f"""WITH {", ".join(parts)}
SELECT z.vec_id, CAST(z.cluster AS INTEGER) AS cluster, z.distance, CAST(sum(z.distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(z.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} c ON c.j = z.cluster"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.fullmatch(r"op\d+_\w+", name) and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force in tests/llm."""
    return {"op6_suffixes": OP6_SQL, "op9_decontamination": OP9_SQL, "op13_centroids": _lloyd_sql()}
