"""Projection of tokens, cost and time, calibrated from finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.scalars import CACHE_READ_RATE, CACHE_WRITE_RATE, token_cost
from scholia.sources.materialise import few, materialised

# Constants of the projection.
SECONDS_PER_SECTION = {"api": 30.0, "cli": 190.0, "codex": 190.0, "demo": 1.0}
SECONDS_PER_PRACTICE = {"api": 75.0, "cli": 260.0, "codex": 260.0, "demo": 2.0}
OUTPUT_PER_SECTION, OUTPUT_PER_QUESTION, CHEAP_INPUT, CHEAP_OUTPUT = 3000, 420, 8000, 4000
INDEX_SECONDS, FIGURE_SECONDS, EXAM_CHARS, ASSUMED_QUESTIONS, CHUNK_TOKENS = 25.0, 95.0, 20_000, 8, 900
DEFAULT_PRICES, DEFAULT_CHEAP_PRICES = (3.0, 15.0), (1.0, 5.0)
SUBSCRIPTIONS = ("cli", "codex", "demo")


def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "calls") if c in usage.columns])


def usage_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model and four counters) with cost; prices (model, input_price, output_price) are one row for each model, an unknown model costs 0."""
    cost = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_creation_tokens"), F.col("cache_read_tokens"), F.col("input_price"), F.col("output_price"))
    return usage.join(few(prices), "model", "left").withColumn("cost", cost).drop("input_price", "output_price")


def section_seconds(documents: DataFrame, limit: int = 10) -> DataFrame:
    """Seconds per unit of the newest ``limit`` measurable runs of every backend and kind."""
    runs = documents.where("duration > 0 and sections > 0")
    order = Window.partitionBy("backend", "kind").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return runs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("backend", "kind", "id", (F.col("duration") / F.col("sections")).alias("seconds"))


def seconds_per_section(runs: DataFrame, defaults: dict[str, float] | None = None, kind: str = "note") -> DataFrame:
    """(backend, seconds, source): the median of a backend's runs, or its constant where there are none."""
    defaults = SECONDS_PER_SECTION if defaults is None else defaults
    known = runs.sparkSession.createDataFrame(sorted(defaults.items()), "backend string, fallback double")
    medians = runs.where(F.col("kind") == kind).groupBy("backend").agg(F.median("seconds").alias("m"))
    return known.join(medians, "backend", "left").select("backend", F.coalesce("m", "fallback").alias("seconds"), F.when(F.col("m").isNotNull(), "history").otherwise("estimate").alias("source"))


def average_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("book_id").agg(F.coalesce(F.nullif(F.avg("token_estimate"), F.lit(0.0)), F.lit(float(CHUNK_TOKENS))).alias("avg_chunk"))


def exam_size_guess(size_bytes: Column) -> Column:
    return F.least(F.floor(size_bytes / 3), F.lit(EXAM_CHARS)).cast("int")


def project_notes(decks: DataFrame, timing: DataFrame, prices: tuple[float, float] = DEFAULT_PRICES, cheap: tuple[float, float] = DEFAULT_CHEAP_PRICES, chunks_per_section: int = 6) -> DataFrame:
    """Tokens, cost and seconds of note runs.

    ``decks`` has deck_id, backend, sections, limit_sections (null: all), context_tokens, system_tokens, exam_chars, section_tokens (of the sections taken), visual_slides,
    image_tokens (mean per visual slide), avg_chunk (null: not indexed), figures (whether figures are scanned); ``timing`` is ``seconds_per_section``.
    """
    rows = decks.join(few(timing), "backend", "left")
    n = F.greatest(F.lit(1), F.least("sections", F.coalesce("limit_sections", "sections")))
    rows = rows.withColumn("n", n).withColumn("prefix", F.col("context_tokens") + F.col("system_tokens") + F.floor(F.least("exam_chars", F.lit(EXAM_CHARS)) / T.CHARS_PER_TOKEN))
    rows = rows.withColumn("cache_write", F.col("prefix").cast("double")).withColumn("cache_read", (F.col("prefix") * (F.col("n") - 1)).cast("double"))
    rows = rows.withColumn("retrieval", chunks_per_section * F.coalesce("avg_chunk", F.lit(float(CHUNK_TOKENS))) * F.col("n")).withColumn("images", F.col("visual_slides") * F.col("image_tokens"))
    rows = rows.withColumn("output", (F.col("n") * OUTPUT_PER_SECTION).cast("double")).withColumn("plain", F.col("images") + F.col("retrieval") + F.col("section_tokens"))
    p_in, p_out = prices
    cost = (F.col("cache_write") * CACHE_WRITE_RATE * p_in + F.col("cache_read") * CACHE_READ_RATE * p_in + F.col("plain") * p_in + F.col("output") * p_out + (F.col("context_tokens") + CHEAP_INPUT) * cheap[0] + CHEAP_OUTPUT * cheap[1]) / 1e6
    uncached = ((F.col("prefix") * F.col("n") + F.col("plain")) * p_in + F.col("output") * p_out) / 1e6
    indexing = F.when(F.col("avg_chunk").isNotNull(), 0.0).otherwise(INDEX_SECONDS + F.when(F.col("figures"), FIGURE_SECONDS).otherwise(0.0))
    return rows.select(
        "deck_id", "backend", "n", "prefix", "cache_write", "cache_read", "retrieval", "images", F.col("section_tokens").cast("double").alias("section_text"), "output",
        F.when(F.col("backend").isin(*SUBSCRIPTIONS), 0.0).otherwise(F.bround(cost, 3)).alias("cost"), F.when(F.col("backend") == "demo", 0.0).otherwise(F.bround(uncached, 3)).alias("no_cache_cost"),
        (F.col("seconds") * F.col("n") + indexing).alias("seconds"), F.col("source").alias("seconds_source"),
    )


def project_practice(decks: DataFrame, runs: DataFrame, prices: tuple[float, float] = DEFAULT_PRICES, cheap: tuple[float, float] = DEFAULT_CHEAP_PRICES) -> DataFrame:
    """Tokens, cost and seconds of practice exams, which are one call each.

    ``decks`` has deck_id, backend, sections, count, system_tokens, slide_tokens, exam_chars, avg_chunk, figures; ``runs`` is ``section_seconds``.
    """
    medians = runs.where("kind = 'practice'").groupBy("backend").agg(F.median("seconds").alias("per_question"))
    fallback = F.create_map(*[F.lit(x) for pair in SECONDS_PER_PRACTICE.items() for x in pair])
    rows = decks.join(few(medians), "backend", "left").withColumn("questions", F.when(F.col("count") > 0, F.col("count")).otherwise(ASSUMED_QUESTIONS))
    excerpts = F.least(2 * F.col("sections"), F.lit(24)) * F.coalesce("avg_chunk", F.lit(float(CHUNK_TOKENS)))
    rows = rows.withColumn("input", F.col("system_tokens") + F.col("slide_tokens") + F.floor(F.least("exam_chars", F.lit(EXAM_CHARS)) / T.CHARS_PER_TOKEN) + excerpts).withColumn("output", (F.col("questions") * OUTPUT_PER_QUESTION).cast("double"))
    cost = (F.col("input") * prices[0] + F.col("output") * prices[1] + (F.col("slide_tokens") + CHEAP_INPUT) * cheap[0] + CHEAP_OUTPUT * cheap[1]) / 1e6
    indexing = F.when(F.col("avg_chunk").isNotNull(), 0.0).otherwise(INDEX_SECONDS + F.when(F.col("figures"), FIGURE_SECONDS).otherwise(0.0))
    seconds = F.coalesce(F.col("per_question") * F.col("questions"), F.element_at(fallback, F.col("backend")), F.lit(SECONDS_PER_PRACTICE["api"])) + indexing
    return rows.select(
        "deck_id", "backend", "questions", "input", "output", F.when(F.col("backend").isin(*SUBSCRIPTIONS), 0.0).otherwise(F.bround(cost, 3)).alias("cost"),
        seconds.alias("seconds"), F.when(F.col("per_question").isNotNull(), "history").otherwise("estimate").alias("seconds_source"),
    )


#: A JSON text that can hold a usage object names both of its counters.
_NAMES_BOTH = "contains({0}, '\"input_tokens\"') and contains({0}, '\"output_tokens\"')"


def usage_of_logs(lines: DataFrame) -> DataFrame:
    """(log_id, input_tokens, output_tokens, cache_read_tokens, calls): the last object of a log, at any depth, that has input and output tokens. ``lines`` has log_id, line_no, line.

    Objects are visited in the order of the text, an object before what it holds. Lines that aren't JSON are passed over; a log without such an object has zeros. Descends level by level, one job
    for each, and only into values that name both counters. What is parsed comes out of a generator: filters on it would parse each text again, once for each mention.
    """

    def parsed(rows: DataFrame, name: str, value: F.Column) -> DataFrame:
        return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))

    level = lines.select("log_id", "line_no", F.array().cast("array<int>").alias("path"), F.col("line").alias("json")).where(_NAMES_BOTH.format("line"))
    level = parsed(level, "kind", F.schema_of_variant(F.try_parse_json("json")))
    seen = None
    while True:
        level = materialised(level.where("kind like 'OBJECT%' or kind like 'ARRAY%'"))
        if not level.limit(1).count():
            break
        objects = parsed(level.where("kind like 'OBJECT%'"), "fields", F.from_json("json", "map<string,string>"))
        has = objects.where(F.array_contains(F.map_keys("fields"), "input_tokens") & F.array_contains(F.map_keys("fields"), "output_tokens")).select("log_id", F.struct("line_no", "path").alias("at"), "fields")
        best = has.groupBy("log_id").agg(F.max_by("fields", "at").alias("fields"), F.max("at").alias("at"))
        seen = best if seen is None else seen.unionByName(best)
        # texts keep the order of keys, variants tell an object from a string that looks like one
        members = objects.select("log_id", "line_no", "path", F.map_values("fields").alias("texts"), F.map_values(F.from_json("json", "map<string,variant>")).alias("values"))
        items = level.where("kind like 'ARRAY%'").select("log_id", "line_no", "path", F.from_json("json", "array<string>").alias("texts"), F.from_json("json", "array<variant>").alias("values"))
        both = members.unionByName(items).select("log_id", "line_no", "path", F.posexplode(F.arrays_zip("texts", "values")).alias("i", "x"))
        named = both.where(_NAMES_BOTH.format("x.texts")).select("log_id", "line_no", F.concat("path", F.array("i")).alias("path"), F.col("x.texts").alias("json"), F.col("x.values").alias("value"))
        level = parsed(named, "kind", F.schema_of_variant("value")).drop("value")
    logs = lines.select("log_id").distinct()
    if seen is None:
        last = logs.withColumn("fields", F.lit(None).cast("map<string,string>"))
    else:
        last = logs.join(seen.groupBy("log_id").agg(F.max_by("fields", "at").alias("fields")), "log_id", "left")

    def counter(*names: str) -> F.Column:
        """The first of the names that the object has, even if it is null there."""
        value = F.lit(None).cast("string")
        for name in reversed(names):
            value = F.when(F.array_contains(F.map_keys("fields"), name), F.element_at("fields", name)).otherwise(value)
        return F.coalesce(value.try_cast("double").cast("long"), F.lit(0))

    return last.select("log_id", counter("input_tokens").alias("input_tokens"), counter("output_tokens").alias("output_tokens"), counter("cached_input_tokens", "cache_read_input_tokens").alias("cache_read_tokens"), F.lit(1).cast("long").alias("calls"))
