"""Print logs and slicer reports as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_duration
from ..operators.ordered import carry_forward, dedupe_first

# Settings kept from a log and their names here.
SETTINGS = {
    "filament_colour": "colour", "filament_type": "type", "filament_cost": "cost_per_kg", "filament_settings_id": "settings",
    "printer_model": "printer", "nozzle_diameter": "nozzle_mm", "layer_height": "layer_mm",
}
IGNORED_FEATURES = ["Prime tower", "Brim", "Custom", "Flush"]
SPOOL_G = 1000.0


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of many log files with their file and number; whole files are split, so their order is kept by offset."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.select("file", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "line")


def print_log_stats(lines: DataFrame) -> DataFrame:
    """One row per log: times, layers, lengths and weights per extruder, settings, and whether it can be used.

    Only comment lines are looked at, and each is reduced to what it states before the files are grouped.
    """
    text = F.trim(F.expr("substring(line, 2)"))
    comments = lines.where(F.col("line").startswith(";")).select("file", "line_no", text.alias("c"))

    def after(label: str) -> Column:
        return F.when(F.col("c").startswith(label), F.trim(F.element_at(F.split("c", ":", 2), 2)))

    def timed(label: str) -> Column:
        part = F.regexp_extract("c", label + r":\s*([^;]*)", 1)
        return F.when(F.col("c").startswith("model printing time:") & (part != ""), parse_duration(part))

    numbers = lambda v: F.transform(F.split(v, ","), lambda n: n.try_cast("double"))
    stated = [
        timed("model printing time").alias("model_seconds"), timed("total estimated time").alias("seconds"), after("total layer number:").try_cast("bigint").alias("layers"),
        numbers(after("total filament length [mm]")).alias("length_mm"), numbers(after("total filament weight [g]")).alias("weight_g")]
    for key, name in SETTINGS.items():
        value = F.when(F.col("c").startswith(key + " = "), F.expr(f"substring(c, {len(key) + 4})"))
        stated.append(F.transform(F.split(value, "[;,]"), lambda v: F.trim(F.regexp_replace(F.trim(v), '^"+|"+$', ""))).alias(name))
    facts = comments.select("file", "line_no", *stated)
    names = ["model_seconds", "seconds", "layers", "length_mm", "weight_g", *SETTINGS.values()]
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in names]
    stating = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
    per_file = facts.where(stating).groupBy("file").agg(*last)
    usable = F.col("weight_g").isNotNull() & F.col("seconds").isNotNull()
    every = lines.select("file").distinct()
    return every.join(per_file, "file", "left").withColumn("status", F.when(usable, "ok").otherwise("error: filament or time totals missing"))


def log_filaments(stats: DataFrame) -> DataFrame:
    """One row per extruder of each usable log: label, colour, grams, metres, cost."""
    at = lambda c: F.get(c, F.col("k"))
    rows = stats.where(F.col("status") == "ok").select("*", F.posexplode("weight_g").alias("k", "total_g"))
    cost = F.when(at("cost_per_kg").isNotNull(), F.col("total_g") / SPOOL_G * at("cost_per_kg").try_cast("double"))
    return rows.select(
        F.col("file").alias("model"), F.lit(1).alias("plates"), "seconds", (F.col("k") + 1).alias("extruder"), F.concat(F.lit("Filament "), (F.col("k") + 1).cast("string")).alias("label"),
        at("colour").alias("colour"), at("type").alias("type"), "total_g", F.lit(None).cast("double").alias("model_g"), (at("length_mm") / 1000).alias("length_m"), cost.alias("cost_usd"))


PLATES_JSON = """sliced_plates array<struct<filament_change_times: double, warning_message: string,
    filaments: array<struct<id: string, main_used_g: double>>, feature_type_times: map<string, double>>>"""


def slice_report_stats(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per report its tool changes, purge seconds and warnings; and per filament its model grams.

    ``reports`` have ``model`` and the report's JSON ``text``.
    """
    plates = reports.select("model", F.explode(F.from_json("text", PLATES_JSON)["sliced_plates"]).alias("p"))
    # a model's distinct warnings are few kinds of text, so the set per model stays small
    totals = plates.groupBy("model").agg(
        F.sum(F.coalesce("p.filament_change_times", F.lit(0.0))).alias("changes"), F.sum(F.coalesce(F.element_at("p.feature_type_times", "Flush"), F.lit(0.0))).alias("flush_seconds"),
        F.count("*").alias("plates"), F.array_sort(F.collect_set(F.nullif("p.warning_message", F.lit("")))).alias("warnings"))
    filaments = plates.select("model", F.explode("p.filaments").alias("f")).groupBy("model", F.col("f.id").cast("int").alias("extruder")).agg(F.sum("f.main_used_g").alias("model_g"))
    return totals, filaments


def slice_info_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from the slicer's XML: time and plates per file, grams and metres per filament; empty plates left out."""
    schema = "metadata array<struct<_key: string, _value: string>>, filament array<struct<_id: int, _type: string, _color: string, _used_m: double, _used_g: double>>"
    plates = spark.read.format("xml").option("rowTag", "plate").schema(schema).load(path).select("*", F.col("_metadata.file_name").alias("model")).where(F.size("filament") > 0)
    predicted = F.get(F.filter("metadata", lambda m: m["_key"] == "prediction"), F.lit(0))["_value"].try_cast("double")
    totals = plates.groupBy("model").agg(F.sum(F.coalesce(predicted, F.lit(0.0))).alias("seconds"), F.count("*").alias("plates"))
    filaments = plates.select("model", F.explode("filament").alias("f")).groupBy("model", F.col("f._id").alias("extruder")).agg(
        F.sum(F.coalesce("f._used_g", F.lit(0.0))).alias("total_g"), (F.sum(F.coalesce("f._used_m", F.lit(0.0))) * 1000).alias("length_mm"),
        F.first("f._color", ignorenulls=True).alias("colour"), F.first("f._type", ignorenulls=True).alias("type"))
    return totals, filaments


def print_summary(entries: DataFrame) -> DataFrame:
    """Totals per extruder over all models; ``entries`` are filament rows with a source ``entry_order``.

    The label is the first real one (else the last), the colour the first given; a missing cost counts 0. Grams nobody
    split into model and purge are counted apart.
    """
    real = ~F.col("label").startswith("Filament ")
    split = F.col("model_g").isNotNull()
    return entries.groupBy("extruder").agg(
        F.coalesce(F.min_by("label", F.when(real, F.col("entry_order"))), F.max_by("label", "entry_order")).alias("label"),
        F.min_by("colour", F.when(F.coalesce("colour", F.lit("")) != "", F.col("entry_order"))).alias("colour"),
        F.sum("total_g").alias("total_g"), F.sum(F.coalesce("model_g", F.lit(0.0))).alias("model_g"), F.sum(F.when(split, F.col("total_g") - F.col("model_g")).otherwise(0.0)).alias("purge_g"),
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), F.sum(F.when(~split, F.col("total_g")).otherwise(0.0)).alias("unsplit_g"), F.count_if(~split).alias("unsplit_entries"))


def print_totals(entries: DataFrame) -> DataFrame:
    """One row over all models: how many, plates, seconds in total and their spread, and the purge share."""
    models = entries.groupBy("model").agg(F.max("plates").alias("plates"), F.max("seconds").alias("seconds"))
    times = models.agg(
        F.count("*").alias("models"), F.sum("plates").alias("plates"), F.sum("seconds").alias("seconds"), F.min("seconds").alias("shortest"),
        F.avg("seconds").alias("mean"), F.max("seconds").alias("longest")).withColumn("_one", F.lit(1))
    grams = entries.agg(
        F.sum("total_g").alias("total_g"), F.sum(F.when(F.col("model_g").isNotNull(), F.col("total_g") - F.col("model_g"))).alias("_purge"),
        F.sum(F.when(F.col("model_g").isNotNull(), F.col("total_g"))).alias("_split")).withColumn("_one", F.lit(1))
    return times.join(grams, "_one").withColumn("purge_share", F.col("_purge") / F.nullif(F.col("_split"), F.lit(0.0))).drop("_one", "_purge", "_split")


def unsplit_models(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("model_g").isNull()).select("model").distinct()


def drop_shadowed_models(models: DataFrame, suffix: str = ".gcode.3mf") -> DataFrame:
    """Models without the sliced projects whose own source model is in the list too."""
    source = F.concat(F.regexp_replace("model", suffix.replace(".", r"\.") + "$", ""), F.lit(".3mf"))
    is_sliced = F.coalesce(F.col("model").endswith(suffix), F.lit(False))
    sliced = models.where(is_sliced).withColumn("_source", source)
    # the others stay out of the join: without a source they would all meet in the task of the NULL key
    shadows = models.select(F.col("model").alias("_source")).distinct()
    return models.where(~is_sliced).unionByName(sliced.join(shadows, "_source", "left_anti").drop("_source"))


def reuse_totals(models: DataFrame, embedded: DataFrame) -> DataFrame:
    """Embedded totals for models whose source digest matches; ``reused`` is false where a model needs slicing.

    Projects of one source carry the same totals, so of several the first by its columns is taken.
    """
    totals = dedupe_first(embedded.withColumnRenamed("source_sha256", "sha256"), ["sha256"], [c for c in embedded.columns if c != "source_sha256"])
    return models.join(totals.withColumn("reused", F.lit(True)), "sha256", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def tool_starts(lines: DataFrame) -> DataFrame:
    """Where each tool of each file first extrudes: its lowest height, the features there, and whether that is allowed.

    Height, tool, feature and tower are carried forward through the lines; brims, towers and flushes do not count. A tool
    above the first needs a bottom surface. Features are a fixed small vocabulary, so their set per tool stays small.
    """
    c = F.trim("line")
    marked = lines.select(
        "file", "line_no", c.alias("c"),
        F.when(c.startswith("; Z_HEIGHT:"), F.trim(F.expr("substring(trim(line), 12)")).try_cast("double")).alias("z"),
        F.when(c.rlike("^T[0-9]+$"), F.expr("substring(trim(line), 2)").try_cast("int")).alias("tool"),
        F.when(c.startswith("; FEATURE:"), F.trim(F.expr("substring(trim(line), 11)"))).alias("feature"),
        F.when(c == "; WIPE_TOWER_START", True).when(c == "; WIPE_TOWER_END", False).alias("tower"))
    state = carry_forward(marked, "file", "line_no", ["z", "tool", "feature", "tower"])
    extruded = F.regexp_extract("c", r"\sE([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    moves = state.where(
        F.col("c").rlike("^G[123] ") & (extruded > 0) & F.col("z").isNotNull() & ~F.coalesce("tower", F.lit(False))
        & ~F.coalesce(F.col("feature").isin(IGNORED_FEATURES), F.lit(False))).withColumn("tool", F.coalesce("tool", F.lit(0)))
    by_level = moves.groupBy("file", "tool", F.round("z", 6).alias("z")).agg(F.collect_set("feature").alias("features"))
    lowest = by_level.groupBy("file", "tool").agg(F.min("z").alias("z"), F.min_by("features", "z").alias("features"))
    ok = (F.col("tool") == 0) | F.array_contains("features", "Bottom surface")
    return lowest.select("file", "tool", "z", F.array_join(F.array_sort("features"), ",").alias("features"), ok.alias("starts_solid"))
