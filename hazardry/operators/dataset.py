"""Unified frames of several sources: projection, union, splits, last-wins and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardry.functions.text import TIME_OF_DAY, WEATHER, classify

#: Tags of the two kinds of source.
SCORED, SEQUENCE = "nuscenes", "dada2000"
SPLITS = ("train", "val", "test")


def _pick(df: DataFrame, names: list[str], default=None, kind: str = "string") -> Column:
    """The first non-null of those columns that exist."""
    found = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default).cast(kind))


def unify_scored(df: DataFrame) -> DataFrame:
    """Scored frames in the unified schema; weather and time come from the description where no column has them."""
    text = _pick(df, ["scene_description", "description"], "")
    names = F.expr("transform(annotations, a -> coalesce(a.category_name, ''))") if "annotations" in df.columns else F.array().cast("array<string>")
    return df.select(
        _pick(df, ["sample_token", "frame_id"], "").alias("frame_id"),
        F.lit(SCORED).alias("source"),
        _pick(df, ["image_path", "cam_front_path"], "").alias("image_path"),
        text.alias("scene_description"),
        F.coalesce(_pick(df, ["weather"]), classify(text, WEATHER)).alias("weather"),
        F.coalesce(_pick(df, ["time_of_day"]), classify(text, TIME_OF_DAY)).alias("time_of_day"),
        _pick(df, ["road_type"], "urban").alias("road_type"),
        F.coalesce(F.array_min(F.filter(names, lambda n: n != "")), F.lit("vehicle")).alias("category"),
        _pick(df, ["rarity_score", "total_score"], 0, "int").alias("rarity_score"),
        F.create_map(
            F.lit("scene_token"), _pick(df, ["scene_token"], ""), F.lit("sample_token"), _pick(df, ["sample_token"], ""), F.lit("camera"), _pick(df, ["camera"], "CAM_FRONT")
        ).alias("source_metadata"),
        (F.col("annotations") if "annotations" in df.columns else F.lit(None)).alias("annotations"),
        F.lit("").alias("split"),
    )


def unify_sequences(df: DataFrame) -> DataFrame:
    """Keyframes of sequences in the unified schema."""
    return df.select(
        _pick(df, ["frame_id"], "").alias("frame_id"),
        F.lit(SEQUENCE).alias("source"),
        _pick(df, ["image_path"], "").alias("image_path"),
        _pick(df, ["description", "scene_description"], "").alias("scene_description"),
        _pick(df, ["weather"], "clear").alias("weather"),
        _pick(df, ["time_of_day"], "day").alias("time_of_day"),
        _pick(df, ["road_type"], "urban").alias("road_type"),
        _pick(df, ["category"], "001").alias("category"),
        F.lit(0).alias("rarity_score"),
        F.create_map(
            F.lit("sequence"), _pick(df, ["sequence"], ""), F.lit("frame_index"), _pick(df, ["frame_index"], "0"), F.lit("frame_type"), _pick(df, ["frame_type"], "critical")
        ).alias("source_metadata"),
        F.lit(None).alias("annotations"),
        F.lit("").alias("split"),
    )


def unified(scored: DataFrame, sequences: DataFrame) -> DataFrame:
    """Both kinds of source together."""
    return unify_scored(scored).unionByName(unify_sequences(sequences), allowMissingColumns=True)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an aggregation that combines before the shuffle, not a window."""
    rows = F.struct(*[F.col(c).alias(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_hz_key")).agg(F.max_by(rows, F.col(order)).alias("_hz_row")).select("_hz_row.*")


def stratified_split(df: DataFrame, id_col: str, strata: list[str], train: float = 0.8, val: float = 0.1, seed: int = 42, least: int = 10) -> DataFrame:
    """A split column with the ratios kept in each stratum; tables of less than ``least`` rows are split in the order of their ids.

    Order within a stratum is that of md5(seed, id); thresholds are rounded half up. The same rows always fall into the same splits.
    A stratum may be of any size: rows are ranked within 4,096 ranges of the hash, whose counts are added up before.
    """
    if df.limit(least).count() < least:
        return sequential_split(df, [id_col], train, val)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = df.withColumns({"_hz_h": hashed, "_hz_s": F.to_json(F.struct(*strata), {"ignoreNullFields": "false"})}).withColumn("_hz_b", F.substring("_hz_h", 1, 3))
    counts = rows.groupBy("_hz_s", "_hz_b").agg(F.count(F.lit(1)).alias("_hz_c"))
    whole = Window.partitionBy("_hz_s")
    before = F.coalesce(F.sum("_hz_c").over(whole.orderBy("_hz_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_hz_s", "_hz_b", before.alias("_hz_before"), F.sum("_hz_c").over(whole).alias("_hz_n"))
    place = F.row_number().over(Window.partitionBy("_hz_s", "_hz_b").orderBy("_hz_h", id_col))
    ranked = rows.withColumn("_hz_in", place).join(counts, ["_hz_s", "_hz_b"]).withColumn("_hz_k", F.col("_hz_in") + F.col("_hz_before"))
    return _cut(ranked, train, val).select(*df.columns, "split")


def hashed_split(df: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """A split column by hash thresholds: ratios hold in expectation in every stratum, and nothing is shuffled (for huge strata)."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    share = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(share < train, "train").when(share < train + val, "val").otherwise("test"))


def sequential_split(df: DataFrame, order: list[str], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """A split column by position in an order; meant for small tables, since positions are global."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    rows = df.withColumns({"_hz_k": F.row_number().over(Window.orderBy(*order)), "_hz_n": n})
    cut1 = F.floor(F.col("_hz_n") * F.lit(train))
    cut2 = cut1 + F.floor(F.col("_hz_n") * F.lit(val))
    return rows.withColumn("split", F.when(F.col("_hz_k") <= cut1, "train").when(F.col("_hz_k") <= cut2, "val").otherwise("test")).drop("_hz_k", "_hz_n")


def _cut(rows: DataFrame, train: float, val: float) -> DataFrame:
    cut1 = F.floor(F.col("_hz_n") * F.lit(train) + F.lit(0.5))
    cut2 = F.floor(F.col("_hz_n") * F.lit(train + val) + F.lit(0.5))
    return rows.withColumn("split", F.when(F.col("_hz_k") <= cut1, "train").when(F.col("_hz_k") <= cut2, "val").otherwise("test")).drop("_hz_k", "_hz_n")


def known_split(split: Column) -> Column:
    """Unknown splits go to train."""
    return F.when(split.isin(*SPLITS), split).otherwise(F.lit("train"))


def statistics(df: DataFrame, by: tuple[str, ...] = ("split", "source", "category")) -> DataFrame:
    """(dimension, value, count) for the total and each value of each dimension, from one pass over grouping sets."""
    sets = [[], *[[F.col(c)] for c in by]]
    counted = df.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
    n = len(by)
    dimension = F.lit("total")
    value = F.lit("all")
    for k, c in enumerate(by):
        here = F.col("g") == (2**n - 1) - 2 ** (n - 1 - k)
        dimension, value = F.when(here, F.lit(c)).otherwise(dimension), F.when(here, F.col(c).cast("string")).otherwise(value)
    return counted.select(dimension.alias("dimension"), value.alias("value"), "count")


def available(frames: DataFrame, listing: DataFrame, path: str = "image_path", name: str = "name", present: bool = True) -> DataFrame:
    """Frames whose file is in a listing (or, with present=False, is not)."""
    files = listing.select(F.col(name).alias("_hz_name"))
    return frames.join(files, F.element_at(F.split(path, "/"), -1) == F.col("_hz_name"), "left_semi" if present else "left_anti")


def image_paths(frames: DataFrame, files: DataFrame, folder: str, images: str, id_col: str = "sample_token") -> DataFrame:
    """(id, image): the exported path (below ``folder`` if relative) where that file is there, else the camera file's name below ``images`` if that is, else null.

    frames: id, exported_image_path, cam_front_path; files: the paths that are there.
    """
    told = F.nullif("exported_image_path", F.lit(""))
    first = F.when(told.startswith("/"), told).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), told))
    second = F.concat(F.lit(images.rstrip("/") + "/"), F.element_at(F.split(F.nullif("cam_front_path", F.lit("")), "/"), -1))
    there = lambda name: files.select(F.col("path").alias(name)).distinct()
    rows = frames.select(id_col, first.alias("_hz_1"), second.alias("_hz_2"))
    met = rows.join(there("_hz_f1"), F.col("_hz_1") == F.col("_hz_f1"), "left").join(there("_hz_f2"), F.col("_hz_2") == F.col("_hz_f2"), "left")
    return met.select(id_col, F.coalesce("_hz_f1", "_hz_f2").alias("image"))


def with_images(frames: DataFrame, paths: DataFrame, id_col: str = "frame_id") -> DataFrame:
    """Frames with image_path from (id, image) where that knows one, their own else."""
    known = paths.select(F.col(paths.columns[0]).alias("_hz_id"), F.col("image").alias("_hz_image"))
    return frames.join(known, F.col(id_col) == F.col("_hz_id"), "left").withColumn("image_path", F.coalesce("_hz_image", "image_path")).drop("_hz_id", "_hz_image")


def training_view(df: DataFrame, prompt: str) -> DataFrame:
    """frame_id, prompt, first annotation as JSON (or {}), metadata."""
    first = F.get("annotations", F.lit(0))
    return df.select(
        "frame_id", F.lit(prompt).alias("prompt"), F.coalesce(F.to_json(first), F.lit("{}")).alias("annotation"), F.struct("source", "weather", "time_of_day", "road_type", "split").alias("metadata")
    )
