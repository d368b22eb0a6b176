"""Album records, selections of files, and the fields of single items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions import metadata as md
from fathom.functions import probe
from fathom.operators import albums as al
from fathom.operators import archive
from fathom.plans.scratch import Scratch
from fathom.sources.tables import table


@query(
    "WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'siglip:x' WHEN 1 THEN 'openai-clip:y' ELSE 'open-clip:z' END AS spec, CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0.15 END::DOUBLE AS floor FROM part) "
    "SELECT p_partkey, CASE WHEN floor = 0.2 AND spec = 'siglip:x' THEN 0.005 WHEN floor = 0.2 AND spec = 'open-clip:z' THEN 0.1 ELSE floor END::DOUBLE AS floor FROM a"
)
def floor_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    spec = F.when(k == 0, "siglip:x").when(k == 1, "openai-clip:y").otherwise("open-clip:z")
    floor = F.when(F.col("p_size") % 2 == 0, 0.2).otherwise(0.15)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", al.migrated_floor(floor, spec).alias("floor"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey / 100.0 END, 0.07)::DOUBLE AS eps, c_nationkey % 2 <> 0 AS auto FROM customer")
def eps_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") / 100.0)
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select("c_custkey", al.eps_state(stored, F.lit(0.07)).alias("s")).select("c_custkey", "s.eps", "s.auto")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('FRANCE', 'PERU', 'CHINA', 'NATION_3', 'NATION_7')")
def unlocked_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.unlocked(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), ["FRANCE", "PERU", "CHINA", "NATION_3", "NATION_7"], "n_name")


@query(
    "SELECT o_orderkey::VARCHAR AS rel, CASE WHEN o_orderkey % 3 = 0 THEN 'b/' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'c/' || o_orderkey END AS path FROM orders"
)
def first_existing_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths under the first of three roots that has them: the second has every third, the third every fifth."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    rel = F.col("o_orderkey").cast("string")
    there = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("b/"), rel).alias("path")).union(o.where("o_orderkey % 5 = 0").select(F.concat(F.lit("c/"), rel).alias("path")))
    return al.first_existing(o.select(rel.alias("rel")), ["a", "b", "c"], there)


@query("SELECT count(*) AS n, sum(n_chars)::BIGINT AS bytes, sum(n_chars) > 2000000000 AS too_large FROM documents WHERE doc_id % 4 <> 1")
def selection_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return al.selection_bytes(d.select(F.col("n_chars").alias("size"), (F.col("doc_id") % 4 != 1).alias("readable")), 2_000_000_000)


@query(
    "WITH d AS (SELECT doc_id, length('doc_' || doc_id || '.txt') AS n_name, coalesce(octet_length(encode(text)), 0) AS n FROM documents), "
    "a AS (SELECT count(*) AS members, sum(n + n_name + 30) AS whole, max(n) AS most FROM d), "
    "w AS (SELECT *, CASE WHEN members >= 65535 OR greatest(whole, most) >= 4294967295 THEN 1 ELSE 0 END AS wide FROM a) "
    "SELECT doc_id, coalesce(sum(n + n_name + 30 + 20 * wide) OVER b, 0)::BIGINT AS entry_at, (whole + 20 * wide * members + coalesce(sum(n_name + 46 + 28 * wide) OVER b, 0))::BIGINT AS record_at "
    "FROM d, w WINDOW b AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def archive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's member and its directory record stand in an archive of all texts, stored as they are."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    placed, _, _ = archive.arranged(d.select(F.col("doc_id").alias("id"), name.alias("source"), name.alias("name"), size.alias("size"), size.alias("packed")), Scratch(spark, "archive"))
    return placed.select(F.col("id").alias("doc_id"), "entry_at", "record_at")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0")
def dropped_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "path")
    return al.dropped_videos(o.withColumn("media", F.when(F.col("path") % 4 == 0, "video").otherwise("image")), o.where("path % 3 = 0"))


@query("SELECT count(*) AS n_excluded, count(*) FILTER (o_orderkey % 7 <> 0)::BIGINT AS n_new FROM orders WHERE o_orderkey % 7 = 0 OR o_custkey % 100 >= 90")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    votes = o.select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 100).cast("double").alias("frequency"))
    return al.exclusion_counts(votes, o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("idx")), 90.0)


@query(
    "SELECT p_partkey, 'Aperture=f/' || (p_size / 2)::DOUBLE || '; Shutter Speed=' || CASE WHEN p_size = 1 THEN '1.0s' ELSE '1/' || p_size || 's' END || '; Focal Length=' || p_size || 'mm; Flash=' || CASE WHEN p_size % 4 = 0 THEN 'No Flash' WHEN p_size % 4 = 1 THEN 'Flash Fired' ELSE 'Flash Mode ' || (p_size % 4) END "
    "|| '; White Balance=' || CASE p_size % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Manual' ELSE 'Mode 2' END || '; Width=' || p_size || ' pixels; GPS Latitude=' || printf('%.6f', p_retailprice / 100) || '°; GPS Altitude=' || (p_partkey % 50)::DOUBLE || 'm' AS said FROM part"
)
def exif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown fields of EXIF records, in order; of two widths the first."""
    size = F.col("p_size")
    record = F.to_json(F.struct(
        (size / 2).alias("FNumber"), (F.lit(1.0) / size).alias("ExposureTime"), size.alias("FocalLength"), (F.col("p_partkey") % 50).cast("double").alias("GPSAltitude"), (size + 7).alias("ExifImageWidth"), size.alias("ImageWidth"), (size % 4).alias("Flash"),
        (size % 3).alias("WhiteBalance"), (F.col("p_retailprice") / 100).alias("GPSLatitudeDecimal"), F.lit("x").alias("Unknown"),
    ))
    shown = md.exif_table(F.parse_json(record))
    said = F.array_join(F.transform(shown, lambda r: F.concat(r["label"], F.lit("="), r["value"])), "; ")
    # rows are small and their work is not: a file that is one task's input is dealt out first
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").repartition("p_partkey").select("p_partkey", said.alias("said"))


@query(
    "SELECT event_id, 'mov,mp4' AS container, (user_id % 60 + 0.5 + 60 * (event_id % 7))::DOUBLE AS duration, CASE WHEN event_id % 5 <> 0 THEN 'h264' END AS codec, CASE WHEN event_id % 5 <> 0 THEN (24 + user_id % 7)::DOUBLE END AS fps FROM events"
)
def probed_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a video tool with tags that look like its own lines, and with nothing but cover art in every fifth."""
    clock = F.format_string("00:%02d:%02d.50", F.col("event_id") % 7, F.col("user_id") % 60)
    art = F.when(F.col("event_id") % 5 == 0, " (attached pic)").otherwise("")
    banner = F.concat(
        F.lit("Input #0, mov,mp4, from 'shows, 2019, from afar.mov':\n  Metadata:\n    title           : holiday\n                    : Duration: 99:59:59.00\n    Stream #7:1: Video: noise, 1 fps\n  Duration: "),
        clock, F.lit(", start: 0.0\n  Stream #0:1: Audio: aac, 48000 Hz\n  Stream #0:0[0x1](und): Video: h264 (High), 640x480, "), (F.col("user_id") % 7 + 24).cast("string"), F.lit(" fps"), art,
    )
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    return e.select("event_id", probe.probed(banner).alias("p")).select("event_id", "p.container", "p.duration", "p.codec", "p.fps")


@query(
    "SELECT event_id, event_id % 4 = 0 AS generated, event_id % 3 <> 0 AS flat, CASE WHEN event_id % 4 = 0 THEN 'app_version=3.1;' ELSE '' END || 'k=' || (props::JSON->>'$.k') || ';said=' || CASE user_id % 3 WHEN 0 THEN '[cat] ' WHEN 1 THEN '{dog} ' ELSE '' END || event_type AS scalars, CASE WHEN event_id % 3 = 0 THEN 'r' || user_id || ',c' || user_id ELSE '' END AS refs FROM events"
)
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record is of a generated image, whether it is flat, its scalars and the files that it refers to."""
    user = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    refs = F.concat(F.lit(', "ref_images": [{"config": {"image": {"image_name": "r'), user, F.lit('"}}}, {"config": {}}], "control_layers": [{"image": {"image_name": "c'), user, F.lit('"}}]'))
    record = F.concat(
        F.lit("{"), F.when(F.col("event_id") % 4 == 0, '"app_version": "3.1", ').otherwise(""), F.lit('"k": '), k, F.lit(', "said": "'), F.element_at(F.array(F.lit("[cat] "), F.lit("{dog} "), F.lit("")), (F.col("user_id") % 3 + 1).cast("int")), F.col("event_type"), F.lit('"'), F.when(F.col("event_id") % 3 == 0, refs).otherwise(""), F.lit("}")
    )
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").withColumn("r", record).withColumn("v", F.parse_json("r"))
    said = F.array_join(F.transform(F.map_entries(md.flat_scalars(F.col("r"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return e.select(
        "event_id", md.has_generation(F.col("v")).alias("generated"), md.is_flat(F.col("r")).alias("flat"), said.alias("scalars"),
        F.array_join(md.referenced_files(F.col("v")), ",").alias("refs"),
    )
