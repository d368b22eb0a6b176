"""Index scans, order, lookups, differences and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions import media as m
from fathom.operators import index as ix
from fathom.sources.surrogates import MEDIA_SQL, files, media
from fathom.sources.tables import table


@query(f"WITH {MEDIA_SQL} SELECT idx, filename, mtime FROM media")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark, sf_dir).select("idx", "filename", "mtime")


@query(f"WITH {MEDIA_SQL} SELECT vec_id, idx FROM media")
def row_to_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, as several files can have one name."""
    return files(spark, sf_dir).select("vec_id").join(media(spark, sf_dir).select("vec_id", "idx"), "vec_id").select("vec_id", "idx")


@query(
    "WITH b AS (SELECT page_id AS idx, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages), r AS (SELECT DISTINCT regexp_extract(url, '([^/]*)$', 1) AS name FROM pages WHERE page_id % 3 = 0 UNION SELECT 'absent-' || item_id FROM benchmark) "
    "SELECT r.name, min(b.idx) AS idx FROM r LEFT JOIN b ON b.base = r.name GROUP BY r.name"
)
def basename_lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to positions: the first of several, null for none."""
    p = table(spark, sf_dir, "pages", "page_id", "url").select(F.col("page_id").alias("idx"), F.regexp_extract("url", "([^/]*)$", 1).alias("base"))
    absent = table(spark, sf_dir, "benchmark", "item_id").select(F.concat(F.lit("absent-"), F.col("item_id").cast("string")).alias("name"))
    asked = p.where("idx % 3 = 0").select(F.col("base").alias("name")).union(absent).distinct()
    first = p.groupBy("base").agg(F.min("idx").alias("idx"))
    return asked.join(first, asked["name"] == first["base"], "left").select("name", "idx")


@query(
    f"WITH {MEDIA_SQL} SELECT count(*) AS n_files, count(*) FILTER (filename LIKE '%.jpg') AS n_images, count(*) FILTER (filename LIKE '%.mp4') AS n_videos, greatest(max(mtime), 50.0) AS last_change FROM media0"
)
def album_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = m.media_type(F.col("filename"))
    return files(spark, sf_dir).agg(
        F.count("*").alias("n_files"), F.count_if(kind == "image").alias("n_images"), F.count_if(kind == "video").alias("n_videos"),
        F.greatest(F.max("mtime"), F.lit(50.0)).alias("last_change"),
    )


@query(f"WITH {MEDIA_SQL} SELECT CASE WHEN filename LIKE '%.mp4' THEN 'video' ELSE 'image' END AS media, count(*) AS n FROM media0 GROUP BY 1")
def media_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(m.media_type(F.col("filename")).alias("media")).agg(F.count("*").alias("n"))


@query(f"WITH {MEDIA_SQL} SELECT vec_id FROM media0 WHERE filename LIKE '%.jpg' AND label <> 3")
def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images among the points; a point without a media type counts as an image."""
    return files(spark, sf_dir).where(m.shown(m.media_type(F.col("filename")), "images") & (F.col("label") != 3)).select("vec_id")


@query(
    "WITH t AS (SELECT * FROM (VALUES (0, 'mp4', 'video/mp4'), (1, 'm4v', 'video/x-m4v'), (2, 'mov', 'video/quicktime'), (3, 'webm', 'video/webm'), (4, 'ogv', 'video/ogg'), (5, 'ogg', 'video/ogg'), (6, 'mkv', 'video/x-matroska'), "
    "(7, 'avi', 'video/x-msvideo'), (8, 'wmv', 'video/x-ms-wmv'), (9, 'flv', 'video/x-flv'), (10, 'asf', 'video/x-ms-asf'), (11, 'mpg', 'video/mpeg'), (12, 'mpeg', 'video/mpeg'), (13, 'm2v', 'video/mpeg'), (14, 'vob', 'video/mpeg'), "
    "(15, 'm2ts', 'video/mp2t'), (16, 'mts', 'video/mp2t'), (17, '3gp', 'video/3gpp'), (18, '3g2', 'video/3gpp2'), (19, 'jpg', 'application/octet-stream')) AS v(k, suffix, served)) "
    "SELECT served, k < 4 AS played, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN t ON user_id % 20 = k GROUP BY ALL"
)
def served_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events' files are served as; suffixes in either case."""
    ends = F.array(*[F.lit(x.upper() if i % 2 else x) for i, x in enumerate((*m.VIDEO_SUFFIXES, ".jpg"))])
    path = F.concat(F.lit("a/b.c/"), F.col("event_id").cast("string"), F.get(ends, (F.col("user_id") % 20).cast("int")))
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    kinds = e.select(m.served_type(path).alias("served"), m.is_played(path).alias("played"), "user_id")
    return kinds.groupBy("served", "played").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN true WHEN n_chars < 1000 THEN false WHEN n_chars > 5000 THEN true ELSE (doc_id * 37) % 600 >= 256 AND (doc_id * 53) % 700 >= 256 END AS passes FROM documents"
)
def dimension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    kind = F.when(F.col("doc_id") % 10 == 0, "video").otherwise("image")
    gate = m.passes_gate(kind, F.col("n_chars"), F.col("doc_id") * 37 % 600, F.col("doc_id") * 53 % 700, 1000, 5000, 256)
    return d.select("doc_id", gate.alias("passes"))


_DIFF = """WITH live AS (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(source || '/' || doc_id || '.jpg') ELSE source || '/' || doc_id || '.jpg' END AS path FROM documents WHERE doc_id % 5 <> 0),
have AS (SELECT source || '/' || doc_id || '.jpg' AS path FROM documents WHERE doc_id % 4 <> 0)"""


def _diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents", "doc_id", "source")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    live = d.where("doc_id % 5 <> 0").select(F.when(F.col("doc_id") % 3 == 0, F.upper(path)).otherwise(path).alias("path"))
    return live, d.where("doc_id % 4 <> 0").select(path.alias("path"))


@query(_DIFF + " SELECT path FROM live WHERE lower(path) NOT IN (SELECT lower(path) FROM have)")
def scan_diff_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.new_files(*_diff(spark, sf_dir))


@query(_DIFF + " SELECT path FROM have WHERE lower(path) NOT IN (SELECT lower(path) FROM live)")
def scan_diff_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, have = _diff(spark, sf_dir)
    return ix.missing_files(have, live)


@query(
    "WITH f AS (SELECT source || '/' || doc_id AS path, n_chars AS size, (doc_id % 11)::DOUBLE AS mtime, doc_id FROM documents) "
    "SELECT path FROM f WHERE NOT (doc_id % 6 = 0 AND doc_id % 4 <> 0)"
)
def reject_cache_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files known as rejects with the same size and time are skipped; a file that changed is looked at again."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    f = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 11).cast("double").alias("mtime"), "doc_id")
    rejects = f.where("doc_id % 6 = 0").select(m.path_key(F.col("path")).alias("key"), F.when(F.col("doc_id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    return ix.without_known_rejects(f, rejects).select("path")


@query("SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'new' END AS origin FROM documents WHERE doc_id % 3 <> 0")
def index_union_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing rows are the even ids, live files all ids that 3 does not divide."""
    d = table(spark, sf_dir, "documents", "doc_id", "source").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    have = d.where("doc_id % 2 = 0").select("path", F.lit("kept").alias("origin"))
    live = d.where("doc_id % 3 <> 0").select("path")
    return ix.updated(have, live, ix.new_files(live, have).withColumn("origin", F.lit("new")))


@query(
    f"WITH {MEDIA_SQL}, gone AS (SELECT idx FROM media WHERE idx % 7 = 2) SELECT m.idx, m.idx - (SELECT count(*) FROM gone g WHERE g.idx < m.idx) AS new_idx FROM media m WHERE m.idx % 7 <> 2"
)
def delete_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = media(spark, sf_dir).select("idx")
    return ix.renumbered(own, own.where("idx % 7 = 2"))


@query(f"WITH {MEDIA_SQL} SELECT idx, filename FROM media WHERE idx % 9 <> 4")
def delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = media(spark, sf_dir).select("idx", "filename")
    return ix.deleted(own, own.where("idx % 9 = 4").select("idx"))


@query(f"WITH {MEDIA_SQL} SELECT idx, CASE WHEN idx = 5 THEN 'moved/there.jpg' ELSE filename END AS filename FROM media")
def rename_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.renamed(media(spark, sf_dir).select("idx", "filename"), 5, "moved/there.jpg", "filename")


@query(
    """WITH s AS (SELECT page_id AS idx, split_part(split_part(url, '/', 3), '.', 1) || '/' || 'p' || (page_id % 40) || '.jpg' AS path FROM pages),
n AS (SELECT *, split_part(path, '/', 2) AS nm, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY idx) AS k FROM s),
a AS (SELECT *, CASE WHEN k = 1 THEN nm ELSE split_part(path, '/', 1) || '_' || nm END AS alt FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY alt ORDER BY k, idx) AS q FROM a)
SELECT idx, path, CASE WHEN q = 1 THEN alt ELSE regexp_replace(alt, '\\.jpg$', '') || '_' || (q - 1) || '.jpg' END AS dest FROM b"""
)
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which a selection is copied to one folder."""
    host = F.split_part(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    s = table(spark, sf_dir, "pages", "page_id", "url").select(F.col("page_id").alias("idx"), F.concat(host, F.lit("/p"), (F.col("page_id") % 40).cast("string"), F.lit(".jpg")).alias("path"))
    return ix.export_names(s)


@query(
    "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS name, s_nationkey AS source FROM supplier"
)
def album_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch keeps what it does not name, and never changes where an album comes from."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("source"))
    changes = s.where("key % 3 = 0 OR key % 5 = 0").select("key", F.when(F.col("key") % 3 == 0, F.upper("name")).alias("name"), F.lit(-1).alias("source"))
    return ix.patched(s, changes, "key", ["source"])


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN NULL ELSE greatest(c_acctbal / 1e5, 0.01) END AS eps FROM customer")
def eps_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored radii that cannot be used become null, too small ones the least allowed."""
    e = F.col("c_acctbal") / 1e5
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.when(F.isnan(e) | (e <= 0), None).otherwise(F.greatest(e, F.lit(0.01))).alias("eps"))


@query(
    "SELECT count(*) FILTER (h.k IS NULL) AS n_missing, count(*) FILTER (h.k IS NOT NULL) AS n_found FROM (SELECT doc_id AS k FROM documents) l LEFT JOIN (SELECT DISTINCT doc_id AS k FROM labels) h ON l.k = h.k"
)
def listed_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of listed files, how many are there."""
    have = table(spark, sf_dir, "labels", "doc_id").distinct().withColumn("_there", F.lit(True))
    return table(spark, sf_dir, "documents", "doc_id").join(have, "doc_id", "left").agg(F.count_if(F.col("_there").isNull()).alias("n_missing"), F.count_if(F.col("_there").isNotNull()).alias("n_found"))


@query("SELECT coalesce(text, '') AS text, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
