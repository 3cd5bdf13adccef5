"""Array, JSON, number and key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and rates of the reference behaviour.
PIXELS_PER_TOKEN = 750
CACHE_WRITE_RATE, CACHE_READ_RATE = 1.25, 0.10
QUESTION_SCHEMA = "number int, kind string, points int, topic string, slides array<int>, prompt string, choices array<string>, answer string, solution string, citations array<string>, modeled_on string"


def figure_area(bbox: Column) -> Column:
    return (bbox["x1"] - bbox["x0"]) * (bbox["bottom"] - bbox["top"])


def figure_label(number: Column) -> Column:
    return F.concat(F.lit("Figure "), number)


def image_tokens(width: Column, height: Column) -> Column:
    return F.floor(width * height / PIXELS_PER_TOKEN).cast("int")


def render_scale(width: Column, height: Column, max_edge: int = 1100) -> Column:
    return F.least(max_edge / F.greatest(width, height), F.lit(3.0))


def crop_scale(width: Column, height: Column, max_edge: int = 900) -> Column:
    return F.least(F.lit(4.0), F.greatest(F.lit(1.0), max_edge / F.greatest(width, height)))


def crop_box(bbox: Column, scale: Column, width: Column, height: Column) -> Column:
    """Pixel box of a crop, half rounded to even and clamped to the page's pixels."""

    def pixel(c: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(c * scale).cast("int"), F.bround(limit * scale).cast("int")))

    return F.struct(pixel(bbox["x0"], width).alias("x0"), pixel(bbox["top"], height).alias("top"), pixel(bbox["x1"], width).alias("x1"), pixel(bbox["bottom"], height).alias("bottom"))


def token_cost(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column, input_price: Column, output_price: Column) -> Column:
    """Price in units per million tokens; an unknown price counts as 0."""
    p_in, p_out = F.coalesce(input_price, F.lit(0.0)), F.coalesce(output_price, F.lit(0.0))
    return (input_tokens * p_in + cache_write * p_in * CACHE_WRITE_RATE + cache_read * p_in * CACHE_READ_RATE + output_tokens * p_out) / 1e6


def usage_add(a: Column, b: Column) -> Column:
    fields = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "calls")
    return F.struct(*[(F.coalesce(a[f], F.lit(0)) + F.coalesce(b[f], F.lit(0))).cast("long").alias(f) for f in fields])


def salvage_json(c: Column, schema: str) -> Column:
    """Parse a JSON answer; on failure parse from its first bracket to its last one."""
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    with_corrupt = f"{schema}, _corrupt string"

    def parsed(text: Column) -> Column:
        value = F.from_json(text, with_corrupt, strict)
        return F.when(value.isNotNull() & value["_corrupt"].isNull(), value.dropFields("_corrupt"))

    inner = F.regexp_extract(c, r"(?s)[\{\[].*[\}\]]", 0)
    return F.coalesce(parsed(c), parsed(F.when(inner != "", inner)))


def coerce_question(item: Column) -> Column:
    """A question from one JSON element, or null if a field has the wrong type, the number is missing or the prompt is blank.

    Integers may be given as numeric strings or whole numbers; a text field that is null or no string rejects the question, a missing one takes its default.
    """
    raw = F.from_json(item, "map<string,string>")
    variant = F.try_parse_json(item)

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(variant, path, "variant")), F.lit("MISSING"))

    def present(field: str) -> Column:
        return F.array_contains(F.map_keys(raw), field)

    def text(field: str) -> tuple[Column, Column]:
        ok = ~present(field) | kind(f"$.{field}").startswith("STRING")
        return ok, F.when(present(field), F.get_json_object(item, f"$.{field}")).otherwise(F.lit(""))

    def whole(value: Column) -> Column:
        return F.when(F.trim(value).rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(F.trim(value), r"\.0*$", "").try_cast("int"))

    def integer(field: str, default: int | None) -> tuple[Column, Column]:
        value = whole(F.get_json_object(item, f"$.{field}"))
        return (value.isNotNull() if default is None else ~present(field) | value.isNotNull()), F.when(present(field), value).otherwise(F.lit(default))

    def array(field: str, of: str) -> tuple[Column, Column]:
        kinds = kind(f"$.{field}")
        members = F.from_json(F.get_json_object(item, f"$.{field}"), "array<string>")
        if of == "int":
            converted = F.transform(members, whole)
            ok = kinds.startswith("ARRAY") & F.forall(converted, lambda x: x.isNotNull())
        else:
            converted = members
            ok = kinds.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(members, lambda x: x.isNotNull())
        empty = F.array().cast(f"array<{of}>")
        return ~present(field) | F.coalesce(ok, F.lit(False)), F.when(present(field), converted).otherwise(empty)

    fields = {
        "number": integer("number", None), "kind": text("kind"), "points": integer("points", 0), "topic": text("topic"), "slides": array("slides", "int"), "prompt": text("prompt"),
        "choices": array("choices", "string"), "answer": text("answer"), "solution": text("solution"), "citations": array("citations", "string"), "modeled_on": text("modeled_on"),
    }
    valid = variant.isNotNull() & raw.isNotNull()
    for ok, _ in fields.values():
        valid = valid & F.coalesce(ok, F.lit(False))
    built = F.struct(*[value.alias(name) for name, (_, value) in fields.items()])
    return F.when(valid & (F.trim(fields["prompt"][1]) != ""), built)


def safe_key(key: Column) -> Column:
    """Whether a storage key is relative and stays inside its root."""
    k = F.replace(key, F.lit("\\"), F.lit("/"))
    return F.coalesce((k != "") & ~k.startswith("/") & ~k.contains(":") & ~F.exists(F.split(k, "/"), lambda s: s.isin(".", "..")), F.lit(False))


def is_visual(image_count: Column, shape_count: Column, lines: Column, fragments: Column, shape_threshold: int = 20) -> Column:
    return (image_count > 0) | (shape_count >= shape_threshold) | ((fragments >= 0.55) & (F.size(lines) >= 15) & (shape_count >= 10))


def has_choices(choices: Column) -> Column:
    return F.size(choices) >= 2


def is_grounded(modeled_on: Column) -> Column:
    return F.coalesce(F.trim(modeled_on) != "", F.lit(False))


def is_failed(error: Column) -> Column:
    return F.coalesce(error != "", F.lit(False))


def can_retry(failed: Column, state_present: Column) -> Column:
    return (F.size(failed) > 0) & state_present


def short_hash(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def elapsed_seconds(started: Column, ended: Column) -> Column:
    """Seconds between two timestamps; 0 if either is missing."""
    return F.coalesce((F.unix_micros(ended) - F.unix_micros(started)) / 1e6, F.lit(0.0))
