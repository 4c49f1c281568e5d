"""Analytics over scored frames; each table is one aggregation, whatever the number of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardry.operators.scoring import SIGNALS


def score_distribution(scored: DataFrame, dense: bool = False, most: int = 6) -> DataFrame:
    """Count of each score, and the running share in percent. The window sees a row per score, after aggregation."""
    counts = scored.groupBy("rarity_score").agg(F.count(F.lit(1)).alias("count"))
    if dense:
        every = scored.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("rarity_score"))
        counts = every.join(counts, "rarity_score", "left").select("rarity_score", F.coalesce("count", F.lit(0)).alias("count"))
    running = F.sum("count").over(Window.orderBy("rarity_score").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.select("rarity_score", "count", F.round(running / total * 100, 2).alias("cumulative_pct"))


def cooccurrence(scored: DataFrame, signals=SIGNALS) -> DataFrame:
    """How many frames have both of each two signals: one pass, then a row for each pair."""
    pairs = [(a, b) for a in signals for b in signals]
    sums = scored.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), F.col(f"`{a}|{b}`").alias("count")) for a, b in pairs])
    return sums.select(F.inline(rows))


def prevalence(scored: DataFrame, signals=SIGNALS) -> DataFrame:
    """Count and percentage of frames of each signal."""
    sums = scored.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in signals])
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("count"), F.round(F.col(s) / F.greatest("n", F.lit(1)) * 100, 2).alias("pct")) for s in signals])
    return sums.select(F.inline(rows))


def scene_stats(scored: DataFrame, scene: str = "scene_token", min_score: int = 3) -> DataFrame:
    """Frames, rare frames, mean, maximum and sum of the scores of each scene, highest mean first."""
    out = scored.groupBy(scene).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.sum((F.col("rarity_score") >= min_score).cast("int")).alias("rare_frame_count"),
        F.round(F.avg("rarity_score"), 3).alias("mean_rarity_score"),
        F.max("rarity_score").alias("max_rarity_score"),
        F.sum("rarity_score").alias("total_rarity"),
    )
    return out.orderBy(F.desc("mean_rarity_score"), scene)


def category_breakdown(frames: DataFrame) -> DataFrame:
    """Annotations of each category, most frequent first."""
    names = frames.select(F.explode("annotations").alias("a")).select(F.col("a.category_name").alias("category_name"))
    return names.groupBy("category_name").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category_name")


def temporal_bursts(rows: DataFrame, scene: str = "scene_token", time: str = "timestamp", tie: str = "sample_token", gap: int = 2_000_000) -> DataFrame:
    """Runs of rows of a scene with no more than a gap between neighbours: prev_timestamp, time_gap, burst_id (from 1)."""
    order = Window.partitionBy(scene).orderBy(time, tie)
    found = rows.withColumn("prev_timestamp", F.lag(time).over(order)).withColumn("time_gap", F.col(time) - F.col("prev_timestamp"))
    first = F.when(F.col("time_gap").isNull() | (F.col("time_gap") > gap), 1).otherwise(0)
    return found.withColumn("burst_id", F.sum(first).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def burst_summary(bursts: DataFrame, scene: str = "scene_token", time: str = "timestamp") -> DataFrame:
    """Rows and span of each burst."""
    return bursts.groupBy(scene, "burst_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min(time).alias("start"), F.max(time).alias("end"), (F.max(time) - F.min(time)).alias("span")
    )


def export_summary(scored: DataFrame, min_score: int = 3) -> DataFrame:
    """Totals and the share that passes, one row."""
    rare = F.count(F.when(F.col("rarity_score") >= min_score, 1))
    return scored.agg(
        F.count(F.lit(1)).alias("total_frames"), rare.alias("filtered_frames"), F.round(rare / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1).alias("filter_rate_pct")
    )
