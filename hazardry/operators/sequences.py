"""Keyframes of ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardry.functions.text import ROAD_TYPE, TIME_OF_DAY, WEATHER, classify, zfill

#: Headers that a sheet may use for each field, compared without case.
HEADERS = {
    "category": ("category", "cat"),
    "sequence": ("sequence", "seq"),
    "accident_frame": ("accident_frame", "accident frame", "frame", "critical"),
    "description": ("description", "scene", "desc"),
    "weather": ("weather", "weather_condition", "condition"),
    "time_of_day": ("time_of_day", "time", "daytime", "lighting"),
    "road_type": ("road_type", "road", "road type", "location"),
}


def normalised_headers(df: DataFrame, headers=HEADERS) -> DataFrame:
    """Columns renamed to the canonical fields whose list of headers has their name."""
    there = {c.lower(): c for c in reversed(df.columns)}
    renames = {}
    for field, names in headers.items():
        if (found := next((there[n] for n in names if n in there), None)) is not None:
            renames[found] = field
    return df.withColumnsRenamed(renames)


def sheet(df: DataFrame) -> DataFrame:
    """An annotation sheet with keys ``category/sequence`` (three digits) and whole accident frames; other rows keep null there."""
    known = normalised_headers(df)
    field = lambda n: F.col(n).cast("string") if n in known.columns else F.lit(None).cast("string")
    return known.select(
        F.concat_ws("/", zfill(field("category"), 3), zfill(field("sequence"), 3)).alias("key"),
        field("accident_frame").try_cast("double").try_cast("int").alias("accident_frame"),
        F.coalesce(field("description"), F.lit("")).alias("description"),
        field("weather").alias("weather"),
        field("time_of_day").alias("time_of_day"),
        field("road_type").alias("road_type"),
    )


def described(sequences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Sequences with their sheet rows; missing enums are inferred from the description."""
    key = F.concat_ws("/", "category", "sequence")
    met = sequences.withColumn("key", key).join(annotations.dropDuplicates(["key"]), "key", "left").drop("key")
    text = F.coalesce("description", F.lit(""))
    return met.withColumns(
        {
            "weather": F.coalesce(F.nullif("weather", F.lit("")), classify(text, WEATHER)),
            "time_of_day": F.coalesce(F.nullif("time_of_day", F.lit("")), classify(text, TIME_OF_DAY)),
            "road_type": F.coalesce(F.nullif("road_type", F.lit("")), classify(text, ROAD_TYPE)),
            "description": text,
        }
    )


def keyframes(frames: DataFrame, keys: list[str], order: list[str], accident: str | None = None, context: int = 2) -> DataFrame:
    """The critical frame of each sequence and up to ``context`` frames before and after it.

    ``accident`` names a column with the 1-based critical frame (clamped to the sequence); null means the last. Adds frame_index (1-based) and
    frame_type.
    """
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    told = F.col(accident).cast("int") if accident else F.lit(None).cast("int")
    placed = frames.withColumns({"frame_index": spot, "_hz_n": n})
    placed = placed.withColumn("_hz_c", F.greatest(F.lit(1), F.least(F.coalesce(told, F.col("_hz_n").cast("int")), F.col("_hz_n").cast("int"))))
    step = F.col("frame_index") - F.col("_hz_c")
    kind = F.when(step < 0, "pre_accident").when(step == 0, "critical").otherwise("mid_accident")
    return placed.filter(F.abs(step) <= context).withColumn("frame_type", kind).drop("_hz_n", "_hz_c")


def budget(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first rows in an order, up to a budget."""
    return rows.orderBy(*order).limit(most)


def frame_file(prefix: str = "dada"):
    """The exported file's name of a keyframe."""
    return F.format_string(f"{prefix}_cat%02d_seq%s_frame%04d_%s", F.col("category").cast("int"), F.col("sequence"), F.col("frame_index").cast("int"), F.col("frame_type"))


def category_distribution(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("category").agg(F.count(F.lit(1)).alias("count")).orderBy("category")


def summary(sequences: DataFrame, accident: str = "accident_frame") -> DataFrame:
    """Sequences, distinct categories and annotated sequences, one row."""
    return sequences.agg(
        F.count(F.lit(1)).alias("total_sequences"), F.countDistinct("category").alias("num_categories"), F.count(accident).alias("annotated_sequences")
    )
