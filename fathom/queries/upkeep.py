"""Side files, kept frames, preferences, folders, records as generated, and whether derived tables are current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.catalog import query
from fathom.functions import media as m
from fathom.functions import metadata as md
from fathom.operators import transfers
from fathom.operators import upkeep as up
from fathom.sources import catalogue
from fathom.sources.derived import staleness
from fathom.sources.surrogates import LAYOUT_SQL, MEDIA_SQL, files, layout
from fathom.sources.tables import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey")


_PATH = "'lib/' || CASE WHEN o_orderkey % 11 = 0 THEN '.h' ELSE 'd' END || (o_orderkey % 6) || CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 6 < 3 THEN '/sub' || (o_orderkey % 3) ELSE '' END || '/' || o_orderkey || '.jpg'"


@query(
    f"WITH p AS (SELECT string_split({_PATH}, '/') AS s FROM orders) SELECT s[2] AS name, bool_or(len(s) > 3) AS has_children FROM p WHERE s[2] NOT LIKE '.%' GROUP BY s[2]"
)
def folder_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.subfolders(_orders(spark, sf_dir).select(F.expr(_PATH).alias("path")), "lib")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/etc/' ELSE '/lib/b/' END || o_orderkey || '.jpg' AS path, o_orderkey % 3 <> 0 AS inside FROM orders"
)
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("'/lib/a' || (o_orderkey % 5) || '/../' || CASE WHEN o_orderkey % 3 = 0 THEN '../etc' ELSE 'b' END || '/./' || o_orderkey || '.jpg'")
    paths = _orders(spark, sf_dir).select("o_orderkey", m.canonical(raw).alias("path"))
    return paths.withColumn("inside", m.inside(F.col("path"), "/lib"))


@query(
    "SELECT 'in/' || o_orderkey || '.txt' AS source, 'out/n' || o_orderkey || '.txt' AS dest FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'in/' || o_orderkey || '.json', 'out/n' || o_orderkey || '.json' FROM orders WHERE o_orderkey % 3 = 0"
)
def export_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    plan = o.select(F.expr("'in/' || o_orderkey || '.jpg'").alias("source"), F.expr("'out/n' || o_orderkey || '.jpg'").alias("dest"))
    texts = o.where("o_orderkey % 2 = 0").select(F.expr("'in/' || o_orderkey || '.txt'").alias("path"))
    return up.sidecars(plan, texts.union(o.where("o_orderkey % 3 = 0").select(F.expr("'in/' || o_orderkey || '.json'").alias("path"))))


_LOG_COLUMNS = (
    "CAST(user_id % 50 AS BIGINT) AS device",
    "event_id AS written",
    "CASE WHEN event_id % 17 = 0 THEN 'forget' WHEN event_id % 7 = 0 THEN 'replace' ELSE 'patch' END AS op",
    "'k' || (event_id % 4) AS key",
    "'v' || event_id AS value",
)
_LOG = ", ".join(_LOG_COLUMNS)


@query(
    f"WITH log AS (SELECT {_LOG} FROM events), c AS (SELECT device, max(written) AS cleared FROM log WHERE op <> 'patch' GROUP BY device) SELECT device, key, arg_max(value, written) AS value FROM log LEFT JOIN c USING (device) WHERE op <> 'forget' AND (cleared IS NULL OR written >= cleared) GROUP BY device, key"
)
def preference_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.preference_state(table(spark, sf_dir, "events", "event_id", "user_id").selectExpr(*_LOG_COLUMNS))


@query(
    f"WITH log AS (SELECT {_LOG} FROM events), c AS (SELECT device, max(written) AS cleared FROM log WHERE op <> 'patch' GROUP BY device), s AS (SELECT device, key, arg_max(value, written) AS value FROM log LEFT JOIN c USING (device) WHERE op <> 'forget' AND (cleared IS NULL OR written >= cleared) GROUP BY device, key), "
    "f AS (SELECT DISTINCT device, unnest(['theme', 'k0']) AS key FROM log), d AS (SELECT device, key, CASE key WHEN 'theme' THEN 'dark' ELSE 'unset' END AS preset FROM f) SELECT device, key, coalesce(value, preset) AS value FROM s FULL JOIN d USING (device, key)"
)
def preference_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device's preferences, with a default for a key that many have set and for one that none has."""
    log = table(spark, sf_dir, "events", "event_id", "user_id").selectExpr(*_LOG_COLUMNS)
    return up.with_defaults(up.preference_state(log), log, {"theme": "dark", "k0": "unset"})


@query(f"WITH {MEDIA_SQL} SELECT filename FROM media0 WHERE vec_id % 4 = 0")
def unused_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames were kept of all files; every fourth file has changed since."""
    f = files(spark, sf_dir)
    now = f.select("vec_id", (F.col("mtime") + F.when(F.col("vec_id") % 4 == 0, 1.0).otherwise(0.0)).alias("mtime"))
    return up.unused_frames(f.select("vec_id", "filename", "mtime"), now, "vec_id").select("filename")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'z' ELSE ' ' END AS c FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0"
)
def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS a", "CASE WHEN o_orderkey % 2 = 0 THEN '' END AS b", "CASE WHEN o_orderkey % 5 = 0 THEN 'z' ELSE ' ' END AS c"
    )
    return up.without_empty(rows, ["a", "b", "c"])


_RECORD = """CONCAT(CASE event_id % 3
  WHEN 0 THEN CONCAT('{"app_version":"2.3.1","model_weights":"m', event_id % 4, '","image":{"prompt":', CASE WHEN event_id % 6 = 0 THEN CONCAT('"[a] cat ', event_id, '"') ELSE CONCAT('[{"prompt":"a cat ', event_id, '"}]') END, ',"seed":', event_id, '}')
  WHEN 1 THEN CONCAT('{"app_version":"3.4.0","model":{"model_name":"m', event_id % 4, '"},"positive_prompt":"a cat ', event_id, '","seed":', event_id)
  ELSE CONCAT('{"app_version":"5.6.0","model":{"name":"m', event_id % 4, '"},"positive_prompt":"a cat ', event_id, '","seed":', event_id,
              ',"ref_images":[{"config":{"image":{"image_name":"r', event_id, '.png"}}}]') END,
  CASE WHEN event_id % 5 = 0 THEN ',"oddity":1' ELSE '' END, '}')"""
_KNOWN = {2: ["app_version", "model_weights", "image"], 3: ["app_version", "model", "positive_prompt", "seed"]}


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END AS version, CASE WHEN event_id % 6 = 0 THEN '[a] cat ' ELSE 'a cat ' END || event_id AS prompt, 'm' || (event_id % 4) AS model, event_id AS seed, CASE WHEN event_id % 3 = 2 THEN 'r' || event_id || '.png' ELSE '' END AS refs, (event_id % 3 = 2 OR event_id % 5 <> 0) AS accepted FROM events"
)
def generation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three versions written from the table's values, and these values read back from them."""
    e = table(spark, sf_dir, "events", "event_id").select("event_id", F.expr(_RECORD).alias("json"))
    v = F.parse_json("json")
    read = e.select(
        "event_id", "json", md.schema_version(v).alias("version"), md.positive_prompt(v).alias("prompt"), md.model_name(v).alias("model"),
        md.seed(v).alias("seed"), F.array_join(md.referenced_files(v), ",").alias("refs"),
    )
    return read.withColumn("accepted", md.accepted(F.col("json"), F.col("version"), _KNOWN)).drop("json")


@query(f"WITH {MEDIA_SQL} SELECT label, max(mtime) AS newest, max(mtime) > label * 10.0 + 45 AS stale FROM media0 GROUP BY label")
def derived_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness(files(spark, sf_dir), F.col("label") * 10.0 + 45, "label")


_POINTS = f"WITH {LAYOUT_SQL}, p AS (SELECT vec_id AS idx, x, y, label AS cluster FROM layout)"


@query(
    f"{_POINTS} SELECT p.idx, sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) AS distance FROM p JOIN p o ON o.idx = 37 AND p.cluster = o.cluster WHERE p.idx % 3 <> 0"
)
def clicked_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the cluster of point 37 that a filter leaves visible."""
    p = layout(spark, sf_dir).select(F.col("vec_id").alias("idx"), "x", "y", F.col("label").alias("cluster"))
    return up.cluster_results(p, 37, p.where("idx % 3 <> 0"))


@query(
    "WITH s AS (SELECT o_orderkey, 'in/' || o_custkey AS source, CASE WHEN o_custkey % 10 = 0 THEN 'in/x' || o_custkey ELSE 'out/' || o_custkey // 2 END AS dest, "
    "CASE WHEN o_custkey % 9 = 0 THEN 'denied' WHEN o_custkey % 7 = 0 THEN 'missing' WHEN o_custkey % 10 = 0 THEN 'same' WHEN o_custkey // 2 % 5 = 0 THEN 'exists' END AS own FROM orders), "
    "w AS (SELECT o_orderkey, first_value(source) OVER d AS winner, row_number() OVER d AS n FROM s WHERE own IS NULL WINDOW d AS (PARTITION BY dest ORDER BY o_orderkey)) "
    "SELECT s.o_orderkey, coalesce(own, CASE WHEN n = 1 THEN 'ready' WHEN winner = source THEN 'missing' ELSE 'exists' END) AS state FROM s LEFT JOIN w USING (o_orderkey)"
)
def transfer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of planned moves, one for each order: repeated sources, taken names, names that two sources want."""
    k = F.col("o_custkey")
    half = F.floor(k / 2)
    dest = F.when(k % 10 == 0, F.concat(F.lit("in/x"), k.cast("string"))).otherwise(F.concat(F.lit("out/"), half.cast("string")))
    stated = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("in/"), k.cast("string")).alias("source"), dest.alias("dest"),
        (k % 7 != 0).alias("found"), (k % 9 != 0).alias("allowed"), ((k % 10 != 0) & (half % 5 == 0)).alias("taken"),
    )
    return transfers.resolved(stated, "move").select(F.col("id").alias("o_orderkey"), "state")


@query(
    "SELECT c_custkey, 'c' || c_custkey AS name, (CASE WHEN c_custkey % 8 = 0 THEN 0 WHEN c_custkey % 2 = 1 THEN 0.5 WHEN c_custkey % 3 = 2 THEN 0.2 ELSE 0.02 END)::DOUBLE AS floor, "
    "CASE WHEN c_custkey % 4 <> 0 THEN 'u' END AS user_name, 'board' AS kind, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS n, CASE WHEN c_custkey % 3 = 2 THEN '1.2.0' ELSE '1.1.0' END AS version FROM customer"
)
def catalogue_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer, migrated by version; every fourth is patched: nulls keep or clear, one field is fixed."""
    k, said = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    record = text('{"name": "c', said, '", "user": "u", "kind": "board", "floor": ', F.when(k % 2 == 0, "0.2").otherwise("0.5"), "}")
    patch = text('{"name": null, "user": null, "kind": "folder", "n": ', said, ', "floor": ', F.when(k % 8 == 0, "0").otherwise("null"), "}")
    c = table(spark, sf_dir, "customer", "c_custkey")
    records = c.select(said.alias("key"), record.alias("record"), F.when(k % 3 == 2, "1.2.0").when(k % 3 == 1, "1.0.0").alias("version"))

    def lower(own):
        return F.when(F.get_json_object(own, "$.floor").try_cast("double") == 0.2, catalogue.with_field(own, "floor", F.lit("0.02"))).otherwise(own)

    now = catalogue.migrated(records, [("1.1.0", lower)])
    out, _ = catalogue.patched(now, c.where(k % 4 == 0).select(said.alias("key"), patch.alias("patch")), ["user"], ["kind"])
    at = lambda name: F.get_json_object("record", f"$.{name}")
    return out.select(F.col("key").cast("long").alias("c_custkey"), at("name").alias("name"), at("floor").cast("double").alias("floor"), at("user").alias("user_name"), at("kind").alias("kind"), at("n").cast("long").alias("n"), "version")
