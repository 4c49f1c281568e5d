"""Sources: JSON lines, JSON arrays, Parquet, catalog tables, trees of frames, model outputs and result files.

Existence is asked of the file system that Spark uses, so every path that Spark can read works.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardry import schemas
from hazardry.functions.text import json_object


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with an explicit schema. Malformed lines are dropped and a missing file is empty, or both fail if ``strict``."""
    if not strict and not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def parquet(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """Parquet with an explicit schema; a missing path is empty. ``lenient`` leaves unreadable files out too."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", lenient).parquet(path) if exists(spark, path) else empty(spark, schema)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array or of JSON lines; the first non-blank character tells which."""
    first = spark.read.text(path).select(F.substring(F.trim("value"), 1, 1).alias("c")).filter("c <> ''").limit(1).collect()
    whole = bool(first) and first[0].c == "["
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Nested frames from JSON lines."""
    return json_lines(spark, path, schemas.FRAME, strict=True)


def scored(spark: SparkSession, path: str) -> DataFrame:
    """A scored table that was written before."""
    return spark.read.parquet(path)


def split_of(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """One split of a partitioned data set, by partition pruning; all of it without a split."""
    rows = spark.read.json(root) if not exists(spark, f"{root}/*/*.parquet") else spark.read.parquet(root)
    return rows if split is None else rows.filter(F.col("split") == split)


_HAZARDS = f"array<struct<{schemas.HAZARD_DDL}>>"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, hazards, parse_failure of prediction records; the raw answer is parsed again where no parsed one is there.

    A line that isn't JSON fails the read.
    """
    rows = json_lines(spark, path, schemas.PREDICTION, strict=True)
    told = F.when(F.coalesce("parse_success", F.lit(False)) & (F.coalesce("parsed_output", F.lit("")) != ""), F.col("parsed_output"))
    answer = F.from_json(F.coalesce(told, json_object(F.col("raw_output"))), f"hazards {_HAZARDS}")
    return rows.select("frame_id", F.coalesce(answer["hazards"], F.array().cast(_HAZARDS)).alias("hazards"), answer.isNull().alias("parse_failure"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, hazards, ord and strata of truth in any of three formats: training records with messages, annotated lines, or a JSON array.

    The first assistant message that parses gives the hazards; else the record's own fields do. Weather, time, location, speed and source are kept.
    """
    schema = (
        f"frame_id string, source string, messages array<struct<role: string, content: string>>, hazards {_HAZARDS}, annotations struct<hazards: {_HAZARDS}>, "
        f"annotation struct<hazards: {_HAZARDS}>, ego_context struct<{schemas.EGO_DDL}>, metadata struct<location: string, ego_speed_kmh: double, source: string>"
    )
    rows = manifest(spark, path, schema)
    spoken = F.filter(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: json_object(m["content"])), lambda x: x.isNotNull())
    answer = F.from_json(F.get(spoken, F.lit(0)), f"hazards {_HAZARDS}")["hazards"]
    return rows.select(
        "frame_id", F.coalesce(answer, "hazards", "annotations.hazards", "annotation.hazards", F.array().cast(_HAZARDS)).alias("hazards"), 
        # the place in the files: numbers alone would follow the splits' order, which is by size
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"),
        F.col("ego_context.weather").alias("weather"), F.col("ego_context.time_of_day").alias("time_of_day"), F.col("metadata.location").alias("location"),
        F.col("metadata.ego_speed_kmh").alias("ego_speed_kmh"), F.coalesce("source", "metadata.source").alias("source"),
    )


def catalog_frames(tables: dict[str, DataFrame]) -> DataFrame:
    """Nested frames from catalog tables: scene, sample, sample_data, ego_pose, sample_annotation, visibility.

    Five equi-joins; distances to the ego vehicle are planar and rounded to 4 digits; the order within a scene is that of the timestamps.
    """
    from hazardry.functions.geometry import planar_distance

    at = lambda c, k: F.get(F.col(c), F.lit(k))
    scene = tables["scene"].select(F.col("token").alias("scene_token"), F.col("description").alias("scene_description"))
    pose = tables["ego_pose"].select(F.col("token").alias("ego_pose_token"), *[at("translation", k).cast("double").alias(f"ego_{n}") for k, n in enumerate("xyz")])
    camera = tables["sample_data"].select("sample_token", F.col("token").alias("cam_front_token"), F.col("filename").alias("cam_front_path"), "ego_pose_token")
    base = tables["sample"].select(F.col("token").alias("sample_token"), "scene_token", "timestamp").join(scene, "scene_token").join(camera, "sample_token").join(pose, "ego_pose_token").drop("ego_pose_token")
    seen = tables["visibility"].select(F.col("token").alias("visibility_token"), F.col("level").try_cast("int").alias("visibility_level"))
    parts = tables["sample_annotation"].join(seen, "visibility_token", "left").join(base.select("sample_token", "ego_x", "ego_y"), "sample_token")
    place = [at("translation", k).cast("double") for k in range(3)]
    one = F.struct(
        "token", "category_name", *[p.alias(f"translation_{n}") for p, n in zip(place, "xyz", strict=True)], F.coalesce("visibility_level", F.lit(4)).alias("visibility_level"),
        planar_distance(place[0], place[1], F.col("ego_x"), F.col("ego_y")).alias("distance_to_ego"),
    )
    folded = parts.select("sample_token", one.alias("a")).groupBy("sample_token").agg(F.array_sort(F.collect_list("a")).alias("annotations"))
    out = base.join(folded, "sample_token", "left").withColumn("annotations", F.coalesce("annotations", F.array()))
    return out.withColumn("num_annotations", F.size("annotations")).orderBy("scene_token", "timestamp", "sample_token")


def frame_tree(spark: SparkSession, root: str, suffix: str = "png") -> DataFrame:
    """Frames below ``category/sequence/images``: category (digits), sequence, name, image_path, bytes. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root).select("path", "length")
    pattern = r"/(\d+)/([^/]+)/images/([^/]+)$"
    found = files.select(*[F.regexp_extract("path", pattern, k).alias(n) for k, n in ((1, "category"), (2, "sequence"), (3, "name"))], F.col("path").alias("image_path"), F.col("length").alias("bytes"))
    return found.filter("category <> ''")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """image_path, width and height; files that don't decode are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("image_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def result_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row; no row if the file is missing or broken."""
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def file_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Files and GiB below a folder, one row; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / 2**30, 6).alias("gib"))


#: Files that hold a model's weights, the first kind that is there counts; its configurations.
WEIGHTS, CONFIG, QUANT_CONFIG = ("safetensors", "bin"), "config.json", "quant_config.json"


def model_statistics(spark: SparkSession, root: str, bits: int = 4) -> DataFrame:
    """One row of a model's folder: weight files, bytes, GiB (3 digits), compression against 16 bits, md5 of the configuration ("" without one), quantised layers."""
    listing = spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    kind = F.element_at(F.split("name", r"\."), -1)
    first = listing.filter(kind == WEIGHTS[0]).limit(1).isEmpty()
    weights = listing.filter(kind == WEIGHTS[int(first)]).agg(F.count(F.lit(1)).alias("weight_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    read = lambda name: (spark.read.format("binaryFile").load(f"{root}/{name}").select("content").first().content if exists(spark, f"{root}/{name}") else b"")
    config, quant = bytes(read(CONFIG)), bytes(read(QUANT_CONFIG))
    layers = json.loads(quant).get("num_quantized_layers", 0) if quant else 0
    gib = F.col("size_bytes") / F.lit(2.0**30)
    return weights.select(
        "weight_files", "size_bytes", F.round(gib, 3).alias("size_gb"), F.when(F.col("size_bytes") > 0, F.lit(round(16 / bits, 2))).otherwise(1.0).alias("compression_ratio"),
        F.lit(hashlib.md5(config).hexdigest() if config else "").alias("config_hash"), F.lit(layers).alias("quantized_layers"),  # noqa: S324  a fingerprint
    )


def together(*parts: tuple[str, DataFrame], tag: str = "split") -> DataFrame:
    """Several tables in one, each with its tag where it has none."""
    tagged = [df.withColumn(tag, F.coalesce(F.col(tag), F.lit(name)) if tag in df.columns else F.lit(name)) for name, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
