"""Legacy forms of generation records: ordered rewrite rules over the fields of an object, as one column expression.

A rule is a function of a map from field to variant. The rules of an adapter run in the order of RULES, each on what the one
before has made; a record's own lists of adapters are rewritten element by element, and everything else passes as it is. A
record without such a list is returned as its own text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Older names of an adapter's model, the first that is there counts.
MODEL_ALIASES = ("clip_vision_model", "ip_adapter_model", "t2i_adapter_model")
#: The two ends of the span of steps, and the list that they become.
STEP_ENDS = ("begin_step_percent", "end_step_percent")
STEP_SPAN = "beginEndStepPct"
#: Fields of an image, and the kind of source that they show; the first that is there counts.
IMAGE_KINDS = (("dataURL", "dataURL"), ("image_name", "file"), ("name", "file"))
#: The lists of adapters of a record.
ADAPTER_LISTS = ("controlnets", "ipAdapters", "t2iAdapters")

_MAP = "map<string,variant>"


def chunk_text(value: Column) -> Column:
    """The text of a chunk of bytes; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(value.cast("string"))


def first_of(parts: Column) -> Column:
    """The text of a chunk that comes with its language and keyword; empty if there are no parts."""
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _fields(v: Column) -> Column:
    return F.from_json(F.to_json(v), _MAP)


def _variant(x: Column) -> Column:
    return F.parse_json(F.to_json(x))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _with(m: Column, key: str, value: Column) -> Column:
    """The map with a field set; a field of that name is replaced."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def model_named(m: Column) -> Column:
    """The model under its present name, where only an older one is there; the older field stays."""
    older = [F.when(F.map_contains_key(m, k), F.lit(k)) for k in MODEL_ALIASES]
    name = F.coalesce(*older)
    return F.when(F.map_contains_key(m, "model") | name.isNull(), m).otherwise(_with(m, "model", F.try_element_at(m, name)))


def steps_joined(m: Column) -> Column:
    """The two ends of the span, numbers or lists, appended to its list; an end of another kind is dropped."""

    def as_list(key: str) -> Column:
        v = F.try_element_at(m, F.lit(key))
        kind = _kind(v)
        number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
        return F.when(number, F.array(v)).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))

    ends = F.filter(F.array(*map(F.lit, STEP_ENDS)), lambda k: F.map_contains_key(m, k))
    added = F.concat(*[as_list(k) for k in STEP_ENDS])
    rest = F.map_filter(m, lambda k, _: ~k.isin(*STEP_ENDS))
    joined = _with(rest, STEP_SPAN, _variant(F.concat(as_list(STEP_SPAN), added)))
    return F.when(F.size(ends) == 0, m).when(F.size(added) == 0, rest).otherwise(joined)


def image_tagged(m: Column) -> Column:
    """An image that is an object says what its source is; any type that it has is replaced, if the source is known."""
    image = F.try_element_at(m, F.lit("image"))

    def of(own: Column) -> Column:
        kind = F.coalesce(*[F.when(F.map_contains_key(own, field), F.lit(name)) for field, name in IMAGE_KINDS])
        return F.when(kind.isNull(), m).otherwise(_with(m, "image", _variant(_with(own, "type", _variant_text(kind)))))

    return F.when(_kind(image).startswith("OBJECT"), _let(_fields(image), of)).otherwise(m)


def _variant_text(x: Column) -> Column:
    return F.parse_json(F.concat(F.lit('"'), x, F.lit('"')))


RULES = (steps_joined, image_tagged, model_named)


def fixed_adapter(v: Column) -> Column:
    """An adapter (a variant) by the present rules; anything but an object is left alone."""
    done = _fields(v)
    for rule in RULES:
        done = _let(done, rule)
    return F.when(_kind(v).startswith("OBJECT"), _variant(done)).otherwise(v)


def fixed_record(json: Column, lists: tuple[str, ...] = ADAPTER_LISTS) -> Column:
    """A record (JSON text) with the adapters of its lists rewritten; null for what is not JSON."""

    def one(key: str):
        def rewrite(m: Column) -> Column:
            own = F.try_element_at(m, F.lit(key))
            items = F.try_variant_get(own, "$", "array<variant>")
            return F.when(_kind(own).startswith("ARRAY"), _with(m, key, _variant(F.transform(items, fixed_adapter)))).otherwise(m)

        return rewrite

    def of(m: Column) -> Column:
        out = m
        for key in lists:
            out = _let(out, one(key))
        has = F.exists(F.map_keys(m), lambda k: k.isin(*lists))
        return F.when(has, F.to_json(out)).otherwise(json)

    return F.when(F.try_parse_json(json).isNotNull(), _let(F.from_json(json, _MAP), of))
