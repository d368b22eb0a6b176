"""Vocabulary, label frequencies and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions import text as t
from fathom.operators import vocabulary as v
from fathom.sources.tables import table

_NORM = "CASE WHEN length(trim(regexp_replace(lower(trim({0})), '[_\\s]+', ' ', 'g'))) BETWEEN 3 AND 60 THEN trim(regexp_replace(lower(trim({0})), '[_\\s]+', ' ', 'g')) END"


@query(
    f"WITH s AS (SELECT {_NORM.format('n_name')} AS phrase, 0 AS source FROM nation UNION ALL SELECT {_NORM.format('p_type')}, 1 FROM part UNION ALL SELECT {_NORM.format('p_name')}, 2 FROM part) SELECT phrase, min(source) AS source FROM s WHERE phrase IS NOT NULL GROUP BY phrase"
)
def vocab_normalize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_type", "p_name")
    own = [table(spark, sf_dir, "nation", "n_name").select(t.phrase(F.col("n_name")).alias("phrase"))]
    own += [part.select(t.phrase(F.col(c)).alias("phrase")) for c in ("p_type", "p_name")]
    return v.by_precedence(own)


@query(f"SELECT {_NORM.format('p_name')} AS phrase, min(p_partkey) AS place FROM part WHERE {_NORM.format('p_name')} IS NOT NULL GROUP BY 1")
def vocab_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").select(t.phrase(F.col("p_name")).alias("phrase"), F.col("p_partkey").alias("place"))
    return v.ordered_distinct(p.where(F.col("phrase").isNotNull()), "phrase", "place")


@query(
    "WITH c AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1) SELECT key, n, p_name AS name FROM c JOIN part ON key = p_partkey WHERE p_partkey % 13 <> 0 ORDER BY n DESC, key LIMIT 100"
)
def label_frequency_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 10").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "part", "p_partkey", "p_name").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return v.top_labels(counts, names, 100).select("key", "n", "name")


@query("WITH c AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity >= 10) SELECT count(*) AS n_unresolved FROM c WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 13 <> 0)")
def label_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 10").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"))
    return v.unresolved(counts, table(spark, sf_dir, "part", "p_partkey").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("key")))


@query("SELECT user_id, event_type AS field, arg_max(value, struct_pack(t := ts, e := event_id)) AS value FROM events GROUP BY 1, 2")
def preferences_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value written for each user and field."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value", "ts", "event_id")
    return e.groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT page_id, array_to_string(list_reverse(string_split(replace(regexp_extract(l, '^/[a-z]/(\\S+)', 1), '_', ' '), '/')), ' ') AS category FROM (SELECT page_id, '/b/base_' || (page_id % 5) || '/mod' || (page_id % 3) || ' ' || page_id AS l FROM pages)")
def place_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    line = F.concat(F.lit("/b/base_"), (k % 5).cast("string"), F.lit("/mod"), (k % 3).cast("string"), F.lit(" "), k.cast("string"))
    return table(spark, sf_dir, "pages", "page_id").select("page_id", v.place_category(line).alias("category"))


@query("SELECT item_id FROM benchmark UNION SELECT doc_id FROM documents WHERE doc_id % 50 = 0")
def bookmark_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks and the current results together."""
    marks = table(spark, sf_dir, "benchmark", "item_id")
    return marks.union(table(spark, sf_dir, "documents", "doc_id").where("doc_id % 50 = 0")).distinct()


@query()
def vocabulary_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_name").select(t.phrase(F.col("p_name")).alias("phrase"))
    return v.fingerprint(p.where(F.col("phrase").isNotNull()))
