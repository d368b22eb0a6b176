"""Metadata: dates, coordinates and versioned generation records in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXIF_FORMAT = "yyyy:MM:dd HH:mm:ss"


def modification_time(original: Column, digitized: Column, changed: Column, fallback: Column) -> Column:
    """Epoch seconds of the first date that can be read, else the file's; dates are taken in the session's time zone."""
    reads = [F.try_to_timestamp(c, F.lit(EXIF_FORMAT)) for c in (original, digitized, changed)]
    return F.coalesce(*[F.unix_micros(r) / F.lit(1e6) for r in reads], fallback)


def decimal_degrees(parts: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and a hemisphere as signed degrees; null unless there are three parts."""
    value = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60.0 + F.get(parts, F.lit(2)) / 3600.0
    return F.when(F.size(parts) == 3, F.when(ref.isin("S", "W"), -value).otherwise(value))


def geocode_key(lat: Column, lon: Column) -> Column:
    """Places within about 11 metres share a key."""
    return F.concat_ws(",", F.format_string("%.4f", F.bround(lat, 4)), F.format_string("%.4f", F.bround(lon, 4)))


def first_json(*chunks: Column) -> Column:
    """The first chunk that is JSON, as a variant; an empty object if none is."""
    return F.coalesce(*[F.try_parse_json(c) for c in chunks], F.parse_json(F.lit("{}")))


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def kind_at(v: Column, path: str) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...> and so on; null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def plain_text_at(v: Column, path: str) -> Column:
    """The text at a path that holds a text, whatever its first character; null for an object, a list or a number."""
    return F.when(kind_at(v, path) == "STRING", text_at(v, path))


def schema_version(v: Column) -> Column:
    """2, 3 or 5: as stated, else by the application's version, else by keys that only one version has."""
    stated = F.try_variant_get(v, "$.metadata_version", "int")
    app = text_at(v, "$.app_version")
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    bare_model = F.schema_of_variant(F.try_variant_get(v, "$.model", "variant")) == "STRING"
    return (
        F.when(stated.isNotNull(), stated)
        .when(app.rlike(r"^v?[12]\."), 2)
        .when(app.rlike(r"^v?3\."), F.when(bare_model, 2).otherwise(3))
        .when(app.isNotNull(), 5)
        .when(has("$.canvas_v2_metadata"), 5)
        .when(has("$.model_weights"), 2)
        .otherwise(3)
    )


def positive_prompt(v: Column) -> Column:
    listed = text_at(v, "$.image.prompt[0].prompt")
    return F.coalesce(F.when(schema_version(v) == 2, F.coalesce(listed, plain_text_at(v, "$.image.prompt"))).otherwise(text_at(v, "$.positive_prompt")), F.lit(""))


def negative_prompt(v: Column) -> Column:
    return F.coalesce(F.when(schema_version(v) != 2, text_at(v, "$.negative_prompt")), F.lit(""))


def model_name(v: Column) -> Column:
    old = F.coalesce(text_at(v, "$.model_weights"), text_at(v, "$.model"))
    named = F.coalesce(text_at(v, "$.model.name"), text_at(v, "$.model.model_name"))
    new = F.coalesce(named, plain_text_at(v, "$.model"))
    return F.coalesce(F.when(schema_version(v) == 2, old).otherwise(new), F.lit(""))


def seed(v: Column) -> Column:
    return F.when(schema_version(v) == 2, F.try_variant_get(v, "$.image.seed", "long")).otherwise(F.try_variant_get(v, "$.seed", "long"))


def loras(v: Column) -> Column:
    """(name, weight) of each adapter, whatever the version calls them."""
    kind = "array<struct<lora:struct<model_name:string>,model:struct<name:string>,weight:double>>"
    own = F.from_json(F.to_json(F.coalesce(F.try_variant_get(v, "$.loras", "variant"), F.parse_json(F.lit("[]")))), kind)
    return F.transform(own, lambda x: F.struct(F.coalesce(x["lora"]["model_name"], x["model"]["name"]).alias("name"), x["weight"].alias("weight")))


#: The settings that a generation is repeated with, from version 3 and from version 5 on, and their names in a recall.
RECALLED = ("steps", "cfg_scale", "cfg_rescale_multiplier", "guidance", "width", "height", "scheduler", "clip_skip", "seamless_x", "seamless_y")
RECALLED_LATER = {
    "refiner_cfg_scale": "refiner_cfg_scale",
    "refiner_steps": "refiner_steps",
    "refiner_start": "refiner_denoise_start",
    "refiner_positive_aesthetic_score": "refiner_positive_aesthetic_score",
    "refiner_negative_aesthetic_score": "refiner_negative_aesthetic_score",
    "strength": "denoise_strength",
}


def reference_images(v: Column) -> Column:
    """(model_name, image_name, weight) of a version 5 record's enabled references; a weight only with a model, and only a number."""
    kind = "array<struct<isEnabled:boolean,config:struct<model:struct<name:string>,image:struct<image_name:string>,weight:variant>>>"
    own = F.from_json(F.to_json(F.coalesce(F.try_variant_get(v, "$.ref_images", "variant"), F.parse_json(F.lit("[]")))), kind)

    def row(r: Column) -> Column:
        c = r["config"]
        number = F.schema_of_variant(c["weight"]).rlike("^(BIGINT|DECIMAL|DOUBLE)")
        name = lambda x: F.when(x != "", x)
        weight = F.when(c["model"].isNotNull() & number, F.try_variant_get(c["weight"], "$", "double"))
        return F.struct(name(c["model"]["name"]).alias("model_name"), name(c["image"]["image_name"]).alias("image_name"), weight.alias("weight"))

    return F.transform(F.filter(own, lambda r: F.coalesce(r["isEnabled"], F.lit(True))), row)


def recall_payload(v: Column, include_seed: bool = True) -> Column:
    """The fields that a generation can be repeated from, as JSON without empty ones.

    References with a model are adapters, others with an image bare ones. Control layers are not among the fields.
    """
    clean = lambda c: F.when(c != "", c)
    fields = [clean(positive_prompt(v)).alias("positive_prompt"), clean(negative_prompt(v)).alias("negative_prompt"), clean(model_name(v)).alias("model")]
    if include_seed:
        fields.append(seed(v).alias("seed"))
    version = schema_version(v)
    some = lambda a: F.when(F.size(a) > 0, a)
    set_at = lambda field, on: F.when(on & (kind_at(v, f"$.{field}") != "VOID"), F.try_variant_get(v, f"$.{field}", "variant"))
    fields += [set_at(field, version != 2).alias(field) for field in RECALLED]
    fields += [set_at(field, version == 5).alias(name) for field, name in RECALLED_LATER.items()]
    named = F.transform(F.filter(loras(v), lambda x: x["name"] != ""), lambda x: F.struct(x["name"].alias("model_name"), x["weight"].alias("weight")))
    fields.append(F.when(version != 2, some(named)).alias("loras"))
    refs = F.when(version == 5, reference_images(v))
    fields.append(some(F.filter(refs, lambda r: r["model_name"].isNotNull())).alias("ip_adapters"))
    bare = F.filter(refs, lambda r: r["model_name"].isNull() & r["image_name"].isNotNull())
    fields.append(some(F.transform(bare, lambda r: F.struct(r["image_name"].alias("image_name")))).alias("reference_images"))
    return F.to_json(F.struct(*fields))


def finite(x: Column) -> Column:
    """Null for what JSON cannot hold."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


#: Codes of the flash, white balance and orientation fields.
FLASH = {
    0: "No Flash",
    1: "Flash Fired",
    5: "Flash Fired, Return not detected",
    7: "Flash Fired, Return detected",
    9: "Flash Fired, Compulsory Flash Mode",
    13: "Flash Fired, Compulsory Flash Mode, Return not detected",
    15: "Flash Fired, Compulsory Flash Mode, Return detected",
    16: "No Flash, Compulsory Flash Suppression",
    24: "No Flash, Auto",
    25: "Flash Fired, Auto",
    29: "Flash Fired, Auto, Return not detected",
    31: "Flash Fired, Auto, Return detected",
    32: "No Flash Available",
}
WHITE_BALANCE = {0: "Auto", 1: "Manual"}
ORIENTATION = {
    1: "Normal",
    2: "Mirrored horizontally",
    3: "Rotated 180°",
    4: "Mirrored vertically",
    5: "Mirrored horizontally, rotated 270° CW",
    6: "Rotated 90° CW",
    7: "Mirrored horizontally, rotated 90° CW",
    8: "Rotated 270° CW",
}
#: EXIF fields in the order in which they are shown, with their labels; of equal labels the first field counts.
EXIF_FIELDS = (
    ("DateTimeOriginal", "Date Taken"),
    ("DateTime", "Date/Time"),
    ("Make", "Camera Make"),
    ("Model", "Camera Model"),
    ("Software", "Software"),
    ("FNumber", "Aperture"),
    ("ExposureTime", "Shutter Speed"),
    ("ISOSpeedRatings", "ISO"),
    ("FocalLength", "Focal Length"),
    ("Flash", "Flash"),
    ("WhiteBalance", "White Balance"),
    ("Orientation", "Orientation"),
    ("ImageWidth", "Width"),
    ("ExifImageWidth", "Width"),
    ("ImageLength", "Height"),
    ("ExifImageHeight", "Height"),
    ("GPSLatitudeDecimal", "GPS Latitude"),
    ("GPSLongitudeDecimal", "GPS Longitude"),
    ("GPSAltitude", "GPS Altitude"),
    ("GPSTimeStamp", "GPS Time"),
)


def float_text(x: Column) -> Column:
    """A double as the shortest decimal that reads back: 4.0, 0.3333333333333333, 1e-05."""
    s = x.cast("string")
    mantissa, power = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", ""), F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    plain = F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0*$", "$1")
    power_text = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(~F.contains(s, F.lit("E")), s).when((power >= 16) | (power < -4), power_text).otherwise(plain)


def number_text(v: Column, path: str) -> Column:
    """A value as it reads in a record: whole numbers without a point, all others with one; texts as they are."""
    kind = kind_at(v, path)
    return F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), float_text(F.try_variant_get(v, path, "double"))).otherwise(text_at(v, path))


def exposure_text(seconds: Column, said: Column | None = None) -> Column:
    """1/n s below a second; from there the number as said, or as a double reads."""
    whole = float_text(seconds) if said is None else said
    return F.when(seconds < 1, F.format_string("1/%ds", F.floor(1 / seconds).cast("int"))).otherwise(F.concat(whole, F.lit("s")))


def coded(value: Column, names: dict[int, str], other: str = "") -> Column:
    """The name of a code, else other before the code."""
    out = F.concat(F.lit(other), value.cast("string"))
    for k, name in names.items():
        out = F.when(value == k, name).otherwise(out)
    return out


def exif_text(v: Column, field: str, keys: Column | None = None) -> Column:
    """The text of one field of an EXIF record (a variant); N/A for a null value, null for a field that is not there.

    keys: the record's fields, for callers that read several.
    """
    path = f"$.{field}"
    text, number, whole = (F.try_variant_get(v, path, kind) for kind in ("string", "double", "int"))
    if field == "ExposureTime":
        out = exposure_text(number, number_text(v, path))
    elif field in ("FNumber", "FocalLength", "GPSAltitude"):
        before, after = {"FNumber": ("f/", ""), "FocalLength": ("", "mm"), "GPSAltitude": ("", "m")}[field]
        out = F.concat(F.lit(before), number_text(v, path), F.lit(after))
    elif field in ("GPSLatitudeDecimal", "GPSLongitudeDecimal"):
        out = F.format_string("%.6f°", number)
    elif field == "Flash":
        out = coded(whole, FLASH, "Flash Mode ")
    elif field == "WhiteBalance":
        out = coded(whole, WHITE_BALANCE, "Mode ")
    elif field == "Orientation":
        out = coded(whole, ORIENTATION, "Orientation ")
    elif field in ("ImageWidth", "ImageLength", "ExifImageWidth", "ExifImageHeight"):
        out = F.concat(text, F.lit(" pixels"))
    else:
        kind = kind_at(v, path)
        out = F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.format_string("%.2f", number)).otherwise(text)
    own = F.json_object_keys(F.to_json(v)) if keys is None else keys
    return F.when(F.array_contains(own, field), F.coalesce(out, F.lit("N/A")))


def exif_table(v: Column) -> Column:
    """The fields to show, in order: array of (label, value). Of fields with one label the first that is there counts."""

    def of(record: Column, keys: Column) -> Column:
        by_label: dict[str, list[Column]] = {}
        for field, label in EXIF_FIELDS:
            by_label.setdefault(label, []).append(exif_text(record, field, keys))
        rows = [F.struct(F.lit(label).alias("label"), F.coalesce(*texts).alias("value")) for label, texts in by_label.items()]
        return F.filter(F.array(*rows), lambda r: r["value"].isNotNull())

    # the record is bound once: as an expression it would be parsed again for each look at a field
    return F.transform(F.array(v), lambda x: F.transform(F.array(F.json_object_keys(F.to_json(x))), lambda keys: of(x, keys))[0])[0]


def has_generation(v: Column) -> Column:
    """Whether a record is one of a generated image."""
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    return has("$.app_version") | has("$.generation_mode") | has("$.canvas_v2_metadata")


def _scalar(json: Column):
    """Whether a field holds no object and no list, by the kind of its value and not by its text."""
    kinds = F.transform_values(F.from_json(json, "map<string,variant>"), lambda k, x: F.schema_of_variant(x))
    return lambda k: ~F.coalesce(F.try_element_at(kinds, k), F.lit("VOID")).rlike("^(OBJECT|ARRAY)")


def flat_scalars(json: Column) -> Column:
    """The top-level scalars of a JSON record as a map of texts; objects and lists are left out."""
    scalar = _scalar(json)
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, x: scalar(k))


def is_flat(json: Column) -> Column:
    """Whether a record has scalars only."""
    scalar = _scalar(json)
    return F.forall(F.json_object_keys(json), scalar)


def referenced_files(v: Column) -> Column:
    """The files that a generation refers to: reference images, then control layers, then raster layers; nulls left out."""
    def named(path: str, inner: str) -> Column:
        own = F.from_json(F.to_json(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("[]")))), "array<string>")
        return F.transform(own, lambda x: F.get_json_object(x, inner))

    every = F.concat(
        named("$.ref_images", "$.config.image.image_name"), named("$.control_layers", "$.image.image_name"), named("$.raster_layers", "$.image.image_name")
    )
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


def unknown_fields(json: Column, known: list[str]) -> Column:
    """The top-level fields of a JSON record that are not known."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, known)))


def accepted(json: Column, version: Column, known: dict[int, list[str]]) -> Column:
    """Whether a record may have the fields that it has: a version with a list has these only, any other may have more."""
    out = F.lit(True)
    for stated, fields in known.items():
        out = F.when(version == stated, F.size(unknown_fields(json, fields)) == 0).otherwise(out)
    return out
