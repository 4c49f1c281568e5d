"""Sinks: Parquet, JSON lines by split, the cache of results, and metric reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardry.functions.text import safe_name
from hazardry.sources import readers

CACHE = "frame_id string, mode string, raw_output string"


def parquet(df: DataFrame, path: str, files: int | None = None, by: str | None = None) -> None:
    """Overwrite a Parquet folder; ``files`` merges small results only."""
    out = (df if files is None else df.coalesce(files)).write.mode("overwrite")
    (out if by is None else out.partitionBy(by)).parquet(path)


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrite a folder of JSON lines, partitioned (by split, say)."""
    out = df.write.mode("overwrite")
    (out if by is None else out.partitionBy(by)).json(path)


def frames(df: DataFrame, path: str) -> None:
    json_lines(df, path)


def splits(df: DataFrame, path: str) -> DataFrame:
    """Write a data set by split; its counts."""
    from hazardry.operators.dataset import known_split

    rows = df.withColumn("split", known_split(F.col("split")))
    json_lines(rows, path, by="split")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("count"))


class ResultCache:
    """A table of results by (frame_id, mode). Misses are an anti-join, so a broken run resumes where it stopped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return readers.parquet(self.spark, self.path, CACHE)

    def misses(self, wanted: DataFrame) -> DataFrame:
        """Those of (frame_id, mode, ...) without a result."""
        return wanted.join(self.rows().select("frame_id", "mode"), ["frame_id", "mode"], "left_anti")

    def put(self, found: DataFrame) -> None:
        """Add results; failures (null) are asked again the next time."""
        found.filter("raw_output IS NOT NULL").select("frame_id", "mode", "raw_output").write.mode("append").parquet(self.path)

    @staticmethod
    def file_name():
        """The name under which a file cache would keep a row."""
        return F.concat(safe_name(F.concat_ws("__", "frame_id", "mode")), F.lit(".json"))


def filtered(scored: DataFrame, rare: DataFrame, root: str, signals: list[str], min_score: int = 3) -> DataFrame:
    """Export rare frames below a folder: ``metadata`` (with exported_image_path), ``score_distribution`` and ``summary``; returns (source, target) of the images to copy."""
    image = F.concat(F.lit("images/"), F.element_at(F.split("cam_front_path", "/"), -1))
    exported = rare.withColumn("exported_image_path", image)
    json_lines(exported, f"{root}/metadata")
    report(scored.groupBy("rarity_score").agg(F.count(F.lit(1)).alias("count")), f"{root}/score_distribution")
    kept = rare.agg(F.count(F.lit(1)).alias("frames_exported"), *[F.count(F.when(F.col(s).cast("int") == 1, 1)).alias(s) for s in signals])
    total = scored.agg(F.count(F.lit(1)).alias("total_frames_scanned"))
    share = F.round(100 * F.col("frames_exported") / F.greatest("total_frames_scanned", F.lit(1)), 1)
    breakdown = F.struct(*signals).alias("signal_breakdown_in_filtered")
    report(total.join(kept).select("total_frames_scanned", "frames_exported", share.alias("filter_rate_pct"), F.lit(min_score).alias("min_rarity_score_used"), breakdown), f"{root}/summary")
    return exported.select(F.col("cam_front_path").alias("source"), F.concat(F.lit(f"{root}/"), "exported_image_path").alias("target"))


def keyframes(rows: DataFrame, root: str, prefix: str = "dada", suffix: str = ".png") -> DataFrame:
    """Export keyframes: JSON lines with the name of each frame's file; returns (source, target) of the images to copy."""
    from hazardry.operators.sequences import frame_file

    named = rows.withColumn("image_file", F.concat(frame_file(prefix), F.lit(suffix)))
    json_lines(named, f"{root}/keyframes")
    return named.select(F.col("image_path").alias("source"), F.concat(F.lit(f"{root}/images/"), "image_file").alias("target"))


def annotated(frames: DataFrame, found: DataFrame, root: str) -> None:
    """Export annotations: the whole manifest, one for each split, counterfactuals apart, the ids of failures, and the quality report.

    frames: frame_id, split ...; found: frame_id, annotation, validation_errors, auto_fixed, mode, ord.
    """
    from hazardry.operators import annotation
    from hazardry.operators.dataset import known_split

    counterfactual = F.coalesce("mode", F.lit("")) == "counterfactual"
    real = found.filter(~counterfactual)
    manifest = annotation.merged(frames, real.filter(F.size("validation_errors") == 0))
    json_lines(manifest, f"{root}/manifest")
    json_lines(manifest.withColumn("split", known_split(F.col("split"))), f"{root}/by_split", by="split")
    json_lines(found.filter(counterfactual), f"{root}/counterfactual")
    json_lines(annotation.missing(frames.select("frame_id"), real.filter(F.size("validation_errors") == 0)), f"{root}/failed_ids")
    report(annotation.quality_report(found), f"{root}/report")


def level_reports(levels: dict[str, DataFrame], root: str, targets: DataFrame | None = None) -> str:
    """Write each level's (metric, value) below its name, all of them below ``final``, and the same as text; returns the text."""
    for name, metrics in levels.items():
        report(metrics, f"{root}/{name}")
    parts = [text_report(metrics, name) for name, metrics in levels.items()]
    if levels:
        report(reduce(DataFrame.unionByName, [m.select(F.lit(n).alias("level"), "metric", F.col("value").cast("double").alias("value")) for n, m in levels.items()]), f"{root}/final")
    if targets is not None:
        report(targets, f"{root}/targets")
        judged = targets.orderBy("metric").collect()
        parts.append("\n".join(["targets", "=======", *[f"{r.metric:<32} {'met' if r.met else 'missed' if r.met is not None else 'unknown'}" for r in judged]]))
    text = "\n\n".join(parts)
    spark = next(iter(levels.values())).sparkSession if levels else targets.sparkSession if targets is not None else None
    if spark is not None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{root}/text")
    return text


def report(metrics: DataFrame, path: str) -> None:
    """A tidy metric table (small) as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def text_report(metrics: DataFrame, title: str, width: int = 40) -> str:
    """A tidy metric table (small) of (metric, value) as text with bars, one line for each row."""
    rows = metrics.orderBy("metric").collect()
    most = max((abs(r.value) for r in rows if r.value), default=1.0)
    lines = [f"{r.metric:<32} {r.value if r.value is not None else '-':>12}  {'#' * int(width * abs(r.value or 0) / most)}" for r in rows]
    return "\n".join([title, "=" * len(title), *lines])
