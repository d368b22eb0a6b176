"""Dates, coordinates, generation records and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions import media as m
from fathom.functions import fixups
from fathom.functions import metadata as md
from fathom.functions import text as t
from fathom.sources import headers
from fathom.sources.tables import table


@query(
    "WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'garbage' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts + INTERVAL 1 DAY, '%Y:%m:%d %H:%M:%S') END AS b, user_id::DOUBLE AS f FROM events) "
    "SELECT event_id, coalesce(epoch(try_strptime(a, '%Y:%m:%d %H:%M:%S')), epoch(try_strptime(b, '%Y:%m:%d %H:%M:%S')), f)::DOUBLE AS mtime FROM e"
)
def exif_date_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    text = lambda c: F.date_format(c, md.EXIF_FORMAT)
    a = F.when(F.col("event_id") % 5 == 0, "garbage").otherwise(text(F.col("ts")))
    b = F.when(F.col("event_id") % 3 != 0, text(F.col("ts") + F.expr("INTERVAL 1 DAY")))
    return e.select("event_id", md.modification_time(a, b, F.lit(None).cast("string"), F.col("user_id").cast("double")).alias("mtime"))


@query(
    "WITH c AS (SELECT c_custkey, abs(c_acctbal) AS v, c_acctbal < 0 AS s FROM customer), d AS (SELECT c_custkey, s, floor(v / 100) AS d, (c_custkey % 60)::DOUBLE AS m, (c_custkey * 7 % 60)::DOUBLE AS sec FROM c) SELECT c_custkey, round(CASE WHEN s THEN -1 ELSE 1 END * (d + m / 60.0 + sec / 3600.0), 6)::DOUBLE AS degrees FROM d"
)
def gps_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("c_custkey"), F.abs("c_acctbal")
    parts = F.array(F.floor(v / 100).cast("double"), (k % 60).cast("double"), (k * 7 % 60).cast("double"))
    ref = F.when(F.col("c_acctbal") < 0, "S").otherwise("N")
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.round(md.decimal_degrees(parts, ref), 6).alias("degrees"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def metadata_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "props")
    return e.select("event_id", F.try_variant_get(md.first_json(F.lit("{not json"), F.col("props")), "$.k", "long").alias("k"))


_VERSIONS = ('{"metadata_version": 5}', '{"app_version": "v2.3.5"}', '{"app_version": "3.1", "model": "m"}', '{"app_version": "3.1", "model": {"name": "n"}}', '{"app_version": "4.0"}', '{"canvas_v2_metadata": {}}', '{"model_weights": "w"}', '{"x": 1}')


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 5 WHEN 6 THEN 2 ELSE 3 END AS version FROM events")
def schema_version_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id")
    json = F.element_at(F.array(*map(F.lit, _VERSIONS)), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", md.schema_version(F.parse_json(json)).alias("version"))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'old ' || user_id WHEN 1 THEN 'new ' || user_id ELSE '' END AS prompt, CASE event_id % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'n' ELSE '' END AS model, CASE event_id % 3 WHEN 2 THEN NULL ELSE user_id END AS seed FROM events"
)
def generation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, model and seed, wherever a version keeps them."""
    u = F.col("user_id").cast("string")
    old = F.concat(F.lit('{"model_weights": "w", "image": {"prompt": [{"prompt": "old '), u, F.lit('"}], "seed": '), u, F.lit("}}"))
    new = F.concat(F.lit('{"metadata_version": 5, "positive_prompt": "new '), u, F.lit('", "model": {"name": "n"}, "seed": '), u, F.lit("}"))
    k = F.col("event_id") % 3
    v = F.parse_json(F.when(k == 0, old).when(k == 1, new).otherwise("{}"))
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    return e.select("event_id", md.positive_prompt(v).alias("prompt"), md.model_name(v).alias("model"), md.seed(v).alias("seed"))


@query(
    "WITH e AS (SELECT event_id, value * 20 AS s FROM events), r AS (SELECT event_id, s, round_even(s, 0)::BIGINT AS t FROM e) SELECT event_id, CASE WHEN s < 0 OR s IS NULL THEN 'Unknown' WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS duration FROM r"
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "value").select("event_id", t.duration(F.col("value") * 20).alias("duration"))


@query(
    "SELECT doc_id, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.0f MB', n / 1e6) ELSE printf('%d bytes', n) END AS size FROM (SELECT doc_id, n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1017 ELSE 1000003 END AS n FROM documents)"
)
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    n = F.col("n_chars") * F.when(k == 0, 1).when(k == 1, 1017).otherwise(1000003)
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", t.human_bytes(n).alias("size"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS folder, CASE WHEN url LIKE 'http://www.%' THEN substr(url, 8) ELSE regexp_extract(url, '([^/]*)$', 1) END AS relative FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    relative = F.when(u.startswith("http://www."), m.relative_path(u, ["http:/"])).otherwise(m.relative_path(u, ["/nowhere"]))
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", m.basename(u).alias("base"), m.parent_name(u).alias("folder"), F.when(u.startswith("http://www."), F.substr(u, F.lit(8))).otherwise(relative).alias("relative"))


@query("SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM benchmark")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", t.escaped(F.col("text")).alias("html"))


@query("SELECT s_suppkey, string_split(s_suppkey || '.' || s_nationkey || '.3', '.')::INTEGER[]::VARCHAR AS version, repeat('●', greatest(length(s_name) - 4, 0)) || right(s_name, 4) AS masked FROM supplier")
def version_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.col("s_suppkey").cast("string"), F.lit("."), F.col("s_nationkey").cast("string"), F.lit(".3-rc1"))
    text = F.concat(F.lit("["), F.array_join(F.transform(t.version_tuple(version), lambda x: x.cast("string")), ", "), F.lit("]"))
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name").select("s_suppkey", text.alias("version"), t.masked(F.col("s_name")).alias("masked"))


_OLD_RECORD = """CONCAT('{"seed":', event_id, CASE event_id % 3
  WHEN 0 THEN CONCAT(',"ipAdapters":[{"ip_adapter_model":"m', user_id, '","begin_step_percent":', event_id % 7, ',"end_step_percent":[', event_id % 7 + 1, ',', user_id, '],"image":{"image_name":"', event_type, '"}}, 3]')
  WHEN 1 THEN CONCAT(',"controlnets":[{"beginEndStepPct":[0],"end_step_percent":', user_id, ',"image":{"dataURL":"', event_type, '","type":"old"},"model":"n","t2i_adapter_model":"z"}]')
  ELSE '' END, '}')"""


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'm' || user_id WHEN 1 THEN 'n' END AS model,
    CASE event_id % 3 WHEN 0 THEN '[' || (event_id % 7) || ',' || (event_id % 7 + 1) || ',' || user_id || ']' WHEN 1 THEN '[0,' || user_id || ']' END AS span,
    CASE event_id % 3 WHEN 0 THEN 'file ' || event_type WHEN 1 THEN 'dataURL ' || event_type END AS source, event_id AS seed, event_id % 3 = 2 AS same FROM events"""
)
def record_fixups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with older forms of adapters, written from the table's values, and what the rewritten ones hold."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("old", F.expr(_OLD_RECORD))
    e = e.withColumn("now", fixups.fixed_record(F.col("old")))
    at = lambda path: F.coalesce(*[F.get_json_object("now", f"$.{k}[0].{path}") for k in ("ipAdapters", "controlnets")])
    source = F.concat(at("image.type"), F.lit(" "), F.coalesce(at("image.image_name"), at("image.dataURL")))
    return e.select("event_id", at("model").alias("model"), at("beginEndStepPct").alias("span"), source.alias("source"), F.get_json_object("now", "$.seed").cast("long").alias("seed"), (F.col("now") == F.col("old")).alias("same"))


def _big(n, size: int):
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * size)))


def _little(n, size: int):
    return F.unhex(F.concat(*[F.hex(F.substring(_big(n, size), i, 1)) for i in range(size, 0, -1)]))


def _bytes(said: str):
    return F.unhex(F.lit(said.replace(" ", "")))


@query(
    "WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, (100 + p_partkey % 900)::INT AS w, (50 + p_size * 7)::INT AS h FROM part), "
    "r AS (SELECT *, k = 3 AND 1 + p_partkey % 8 >= 5 AS turned FROM p) "
    "SELECT p_partkey, ['png', 'gif', 'bmp', 'jpeg', 'webp', NULL, 'jpeg'][k + 1] AS format, CASE WHEN k = 5 THEN NULL WHEN turned THEN h ELSE w END AS width, CASE WHEN k = 5 THEN NULL WHEN turned THEN w ELSE h END AS height, "
    "CASE WHEN k = 3 THEN 981173100 + p_partkey * 61 ELSE p_partkey END::DOUBLE AS taken, CASE WHEN k = 0 THEN h::BIGINT END AS seed FROM r"
)
def image_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, upright dimensions, date and seed of images whose heads are made of the parts' numbers; every seventh is cut off."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, w, h = F.col("p_partkey"), 100 + F.col("p_partkey") % 900, 50 + F.col("p_size") * 7
    said = F.encode(F.concat(F.lit('{"seed": '), h.cast("string"), F.lit("}")), "utf-8")
    png = F.concat(_bytes("89504E470D0A1A0A 0000000D 49484452"), _big(w, 4), _big(h, 4), _bytes("0802000000 00000000"))
    png_said = F.concat(png, _big(F.octet_length(said) + 5, 4), _bytes("74455874 6D65746100"), said, _bytes("00000000"))
    gif = F.concat(_bytes("474946383961"), _little(w, 2), _little(h, 2), _bytes("000000"))
    bmp = F.concat(_bytes("424D" + "00" * 12 + "28000000"), _little(w, 4), _little(-h, 4))
    date = F.encode(F.date_format(F.timestamp_seconds(F.lit(981173100) + k * 61), md.EXIF_FORMAT), "utf-8")
    exif = F.concat(
        _bytes("FFE10054 457869660000 4D4D002A00000008 0002 0112000300000001"), _big(1 + k % 8, 2), _bytes("0000 876900040000000100000026 00000000 0001 900300020000001400000038 00000000"), date, _bytes("00")
    )
    frame = F.concat(_bytes("FFC2000908"), _big(h, 2), _big(w, 2), _bytes("0101"))
    webp = F.concat(_bytes("52494646 1E000000 57454250 56503858 0A000000 00000000"), _little(w - 1, 3), _little(h - 1, 3))
    kinds = [png_said, gif, bmp, F.concat(_bytes("FFD8"), exif, frame), webp, F.substring(png, 1, 20), F.concat(_bytes("FFD8 FFFE000461FF"), frame)]
    made = F.coalesce(*[F.when(k % 7 == i, c) for i, c in enumerate(kinds)])
    read = p.select("p_partkey", headers.header(made).alias("i")).select("p_partkey", "i.*")
    width, height = headers.upright(F.col("width"), F.col("height"), F.col("exif"))
    seed = md.seed(headers.record(F.col("exif"), F.col("texts"), "meta"))
    return read.select("p_partkey", "format", width.alias("width"), height.alias("height"), headers.taken_at(F.col("exif"), k.cast("double")).alias("taken"), seed.alias("seed"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"positive_prompt\":\"cat ' || event_id || '\",\"model\":\"m\",\"seed\":' || user_id || '}' "
    "ELSE '{\"positive_prompt\":\"cat ' || event_id || '\",\"model\":\"m\",\"seed\":' || user_id || ',\"steps\":' || user_id % 50 || ',\"scheduler\":\"' || event_type || '\"' "
    "|| CASE WHEN event_id % 3 = 1 THEN '' ELSE ',\"denoise_strength\":0.5,\"loras\":[{\"model_name\":\"l' || user_id % 9 || '\",\"weight\":0.25}],\"ip_adapters\":[{\"model_name\":\"a\",\"image_name\":\"r' || event_id || '.png\",\"weight\":1.5}],\"reference_images\":[{\"image_name\":\"b.png\"}]' END || '}' END AS payload FROM events"
)
def recall_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records of three versions are repeated from; of the last, references with and without a model, and disabled ones."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    said, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    old = text('{"app_version": "2.3", "model_weights": "m", "steps": 9, "image": {"prompt": [{"prompt": "cat ', said, '"}], "seed": ', user, "}}")
    common = text('"positive_prompt": "cat ', said, '", "model": {"name": "m"}, "negative_prompt": "", "seed": ', user, ', "width": null, "steps": ', (F.col("user_id") % 50).cast("string"), ', "scheduler": "', F.col("event_type"), '"')
    refs = text('[{"isEnabled": true, "config": {"model": {"name": "a"}, "image": {"image_name": "r', said, '.png"}, "weight": 1.5}}, {"config": {"image": {"image_name": "b.png"}, "weight": 1}}, {"isEnabled": false, "config": {"image": {"image_name": "c.png"}}}]')
    middle = text('{"app_version": "3.1", "strength": 0.5, ', common, "}")
    new = text('{"app_version": "5.6", "strength": 0.5, "loras": [{"model": {"name": "l', (F.col("user_id") % 9).cast("string"), '"}, "weight": 0.25}], "ref_images": ', refs, ", ", common, "}")
    record = F.when(F.col("event_id") % 3 == 0, old).when(F.col("event_id") % 3 == 1, middle).otherwise(new)
    return e.select("event_id", md.recall_payload(F.parse_json(record)).alias("payload"))
