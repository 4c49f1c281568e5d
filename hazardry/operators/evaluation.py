"""Four levels of evaluation as tidy metric tables.

Boxes are matched once; detection, classes, severity and every stratum are aggregations over that one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardry.operators.annotation import LABELS
from hazardry.operators.dataset import last_wins
from hazardry.operators.matching import match_frames

#: Order of severities; targets of the levels (metric, comparison, value).
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}
TARGETS = (
    ("iou_at_threshold", ">=", 0.60), ("hazard_detection_rate", ">=", 0.80), ("false_positive_rate", "<=", 0.15), ("mean_iou", ">=", 0.55),
    ("latency_t4_p50_ms", "<", 500.0), ("latency_a100_p50_ms", "<", 200.0), ("vit_tensorrt_latency_ms", "<", 25.0), ("throughput_a100_fps", ">=", 8.0),
    ("vram_t4_gb", "<", 6.0), ("quant_degradation_pct", "<=", 2.0),
    ("day_night_gap", "<=", 0.10), ("weather_gap", "<=", 0.15), ("location_gap", "<=", 0.10), ("ood_relative_performance", ">=", 0.70),
)


def ratio(over: Column, under: Column) -> Column:
    """A quotient, 0 where there is nothing to divide by."""
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def active(hazards: Column) -> Column:
    """Hazards but those labelled no_hazard; a missing label counts as a hazard."""
    return F.filter(F.coalesce(hazards, F.array()), lambda h: ~F.coalesce(h["label"] == "no_hazard", F.lit(False)))


def paired(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each prediction (``pred_row``, unless there, is its frame and its place among the frame's predictions) with the last truth of its frame.

    Columns: frame_id, hazards, parse_failure; truth also ord. Predictions that agree in all of these may swap places, so the rows don't depend on partitions.
    """
    last = last_wins(truth.select("frame_id", F.col("hazards").alias("true_hazards"), "ord"), "frame_id", "ord").drop("ord")
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("parse_failure", F.to_json("hazards")))
    rows = predictions if "pred_row" in predictions.columns else predictions.withColumn("pred_row", F.concat_ws("#", F.col("frame_id").cast("string"), place))
    return rows.join(last, "frame_id", "left").select(
        "pred_row", "frame_id", F.coalesce("parse_failure", F.lit(False)).alias("parse_failure"), active(F.col("hazards")).alias("pred"), active(F.col("true_hazards")).alias("true")
    )


def events(pairs: DataFrame, threshold: float = 0.5, method: str = "optimal") -> DataFrame:
    """One row for each matched pair, unmatched prediction and unmatched truth: kind (tp, fp, fn), labels, severities, iou.

    Frames whose answer could not be parsed give a miss for each true hazard.
    """
    boxes = lambda c: F.transform(c, lambda h: h["bbox_2d"])
    both = pairs.filter(~F.col("parse_failure") & (F.size("pred") > 0) & (F.size("true") > 0))
    matched = match_frames(both.select("pred_row", boxes(F.col("pred")).alias("pred_boxes"), boxes(F.col("true")).alias("true_boxes")), "pred_row", threshold=threshold, method=method)
    folded = matched.groupBy("pred_row").agg(F.collect_list(F.struct("pred_idx", "true_idx", "iou")).alias("m"))
    met = pairs.join(folded, "pred_row", "left").withColumn("m", F.coalesce("m", F.array()))
    side = lambda c, k: F.when(F.col("parse_failure") & F.lit(k == "pred"), F.array()).otherwise(
        F.filter(F.transform(c, lambda h, i: F.struct(i.alias("i"), h["label"].alias("label"), h["severity"].alias("severity"))), lambda x: ~F.exists("m", lambda y: y[f"{k}_idx"] == x["i"]))
    )
    none = F.lit(None).cast("string")
    one = lambda kind, pl, tl, ps, ts, v: F.struct(F.lit(kind).alias("kind"), pl.alias("pred_label"), tl.alias("true_label"), ps.alias("pred_severity"), ts.alias("true_severity"), v.alias("iou"))
    at = lambda c, i, f: F.get(F.col(c), i)[f]
    tp = F.transform("m", lambda y: one("tp", at("pred", y["pred_idx"], "label"), at("true", y["true_idx"], "label"), at("pred", y["pred_idx"], "severity"), at("true", y["true_idx"], "severity"), y["iou"]))
    fp = F.transform(side("pred", "pred"), lambda x: one("fp", x["label"], none, x["severity"], none, F.lit(None).cast("double")))
    fn = F.transform(side("true", "true"), lambda x: one("fn", none, x["label"], none, x["severity"], F.lit(None).cast("double")))
    return met.select("pred_row", "frame_id", F.inline(F.concat(tp, fp, fn)))


def detection_metrics(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Level 1 in one row: counts, precision, recall, F1, overlap, frame false-positive rate, label accuracy, parse failures."""
    ok = ~F.col("parse_failure")
    empty = ok & (F.size("true") == 0)
    count = lambda c: F.count(F.when(c, 1))
    frames = pairs.agg(
        F.count(F.lit(1)).alias("total_frames"), count(F.col("parse_failure")).alias("parse_failures"),
        count(empty & (F.size("pred") == 0)).alias("true_negatives"), count(empty & (F.size("pred") > 0)).alias("fp_frames"),
        F.coalesce(F.sum(F.when(ok, F.size("true"))), F.lit(0)).alias("total_gt_hazards"), F.coalesce(F.sum(F.when(ok, F.size("pred"))), F.lit(0)).alias("total_pred_hazards"),
    )
    kinds = found.agg(
        *[count(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")],
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("iou"),
        count((F.col("kind") == "tp") & F.col("pred_label").eqNullSafe(F.col("true_label"))).alias("same"),
    )
    return rates(frames.join(kinds))


def rates(counts: DataFrame) -> DataFrame:
    """The rates of a row of counts."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    still = F.col("true_negatives") + F.col("fp_frames")
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return counts.select(
        r4(ratio(tp, tp + fp + fn), "iou_at_threshold"), r4(recall, "hazard_detection_rate"), r4(ratio(F.col("fp_frames"), still), "false_positive_rate"), r4(precision, "precision"),
        r4(ratio(2 * precision * recall, precision + recall), "f1_score"), r4(F.col("iou"), "mean_iou"), r4(ratio(F.col("same"), tp), "classification_accuracy"),
        "total_frames", "total_gt_hazards", "total_pred_hazards", tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), "true_negatives",
        r4(ratio(F.col("true_negatives"), still), "no_hazard_accuracy"), r4(ratio(F.col("parse_failures"), F.col("total_frames")), "parse_failure_rate"), "parse_failures",
    )


def class_metrics(found: DataFrame, labels=LABELS[:-1]) -> DataFrame:
    """Precision, recall, F1 and count of each label of the domain; a match counts for the true label."""
    label = F.when(F.col("kind") == "fp", F.col("pred_label")).otherwise(F.col("true_label"))
    counts = found.groupBy(label.alias("label")).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("tp", "fp", "fn")])
    domain = found.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    met = F.broadcast(domain).join(counts, "label", "left").na.fill(0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return met.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), (F.col("tp") + F.col("fn")).alias("count"))


def confusion(found: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """(true, predicted, count) of matches."""
    return found.groupBy(true, pred).agg(F.count(F.lit(1)).alias("count"))


def ordinal(severity: Column) -> Column:
    """1 (low) to 4 (critical); null for others."""
    return reduce(lambda c, kv: c.when(severity == kv[0], F.lit(kv[1])), list(SEVERITY.items())[1:], F.when(severity == "low", F.lit(1)))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks, 0 below three rows or where undefined.

    Ranks come from counts of distinct values, joined back, so no window holds all rows in one task.
    """

    def ranked(df: DataFrame, c: str, name: str) -> DataFrame:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        below = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(c, (below + (F.col("n") + 1) / 2).alias(name))

    met = rows.join(ranked(rows, a, "ra"), a).join(ranked(rows, b, "rb"), b)
    # not corr(), which divides by zero where all values of a side are equal
    value = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    return met.agg(F.count(F.lit(1)).alias("n"), F.round(F.when(F.count(F.lit(1)) >= 3, F.coalesce(value, F.lit(0.0))).otherwise(0.0), 4).alias("spearman"))


def severity_metrics(found: DataFrame) -> DataFrame:
    """Exact and within-one agreement and rank correlation of the severities of matches, one row."""
    rows = found.filter("kind = 'tp'").select(ordinal(F.col("pred_severity")).alias("p"), ordinal(F.col("true_severity")).alias("t")).filter("p IS NOT NULL AND t IS NOT NULL")
    mean = lambda c: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 4)
    agreed = rows.agg(mean(F.col("p") == F.col("t")).alias("severity_accuracy"), mean(F.abs(F.col("p") - F.col("t")) <= 1).alias("severity_within_one"))
    return agreed.join(spearman(rows, "p", "t").select(F.col("spearman").alias("severity_spearman")))


def judge_stats(scores: DataFrame) -> DataFrame:
    """Per dimension: mean, median, population deviation, and counts of each score from 1 to 5."""
    return scores.groupBy("dimension").agg(
        F.round(F.avg("score"), 4).alias("mean"), F.round(F.percentile("score", 0.5), 4).alias("median"), F.round(F.stddev_pop("score"), 4).alias("std"),
        *[F.count(F.when(F.col("score") == k, 1)).alias(f"n{k}") for k in range(1, 6)],
    )


def judge_summary(scores: DataFrame, least: float = 3.5) -> DataFrame:
    """Frames, overall mean, share of frames that pass in every dimension, one row."""
    frames = scores.groupBy("frame_id").agg(F.bool_and(F.col("score") >= least).alias("ok"), F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return frames.agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.sum("s") / F.sum("n"), 4).alias("overall_mean"), F.round(ratio(F.count(F.when(F.col("ok"), 1)), F.count(F.lit(1))), 4).alias("pass_rate")
    )


def template_scores(frames: DataFrame, dimensions=("correctness", "completeness", "action_relevance"), seed: int = 42) -> DataFrame:
    """Repeatable scores of 3 to 5 for each frame and dimension: stands in for a judge in tests."""
    rows = frames.select("frame_id", F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("frame_id").cast("string"), "dimension"))
    return rows.withColumn("score", (F.pmod(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long"), F.lit(3)) + 3).cast("int"))


def latency_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, p50, p95, p99 (linear interpolation), serial throughput and count; nulls don't count."""
    out = rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("_m"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("_p"), F.sum(value).alias("_s")
    )
    two = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return out.select(
        *by, "n", two(F.col("_m")).alias("mean_ms"), *[two(F.get("_p", F.lit(k))).alias(name) for k, name in enumerate(("p50_ms", "p95_ms", "p99_ms"))],
        F.round(ratio(F.col("n"), F.coalesce(F.col("_s"), F.lit(0.0)) / 1000), 4).alias("throughput_serial_rps"),
        F.round(ratio(F.lit(1000.0), F.coalesce(F.col("_m"), F.lit(0.0))), 1).alias("fps"),
    )


def speed_bucket(kmh: Column) -> Column:
    v = F.coalesce(kmh, F.lit(0.0))
    return F.when(v < 20, "0-20").when(v < 40, "20-40").otherwise("40+")


def infer_source(frame_id: Column) -> Column:
    return F.when(F.lower(frame_id).startswith("dada"), F.lit("dada2000")).otherwise(F.lit("nuscenes"))


def stratum(*columns: Column) -> Column:
    """The first non-empty of some texts, lower-cased; unknown if there is none."""
    return F.lower(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("unknown")))


def strata(rows: DataFrame, keys: list[str], tp: str = "tp", fn: str = "fn") -> DataFrame:
    """(stratum_key, stratum_value, n_frames, detection_rate) for all keys in one aggregation. Rows: a frame with its counts and strata."""
    each = F.array(*[F.struct(F.lit(k).alias("stratum_key"), F.col(k).cast("string").alias("stratum_value")) for k in keys])
    long = rows.select(tp, fn, F.inline(each))
    return long.groupBy("stratum_key", "stratum_value").agg(
        F.count(F.lit(1)).alias("n_frames"), F.round(ratio(F.sum(tp), F.sum(tp) + F.sum(fn)), 4).alias("detection_rate")
    )


def stratified(predictions: DataFrame, truth: DataFrame, keys: list[str], threshold: float = 0.5, method: str = "optimal") -> DataFrame:
    """strata() of matched events. Every frame with truth (its last) counts in its strata, with or without a prediction; predictions of other frames don't count."""
    known = last_wins(truth.select("frame_id", *keys, "ord"), "frame_id", "ord").drop("ord")
    found = events(paired(predictions.join(known.select("frame_id"), "frame_id", "left_semi"), truth), threshold, method)
    counts = found.groupBy("frame_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("tp", "fn")])
    return strata(known.join(counts, "frame_id", "left").na.fill(0, ["tp", "fn"]), keys)


def speed_ups(stats: DataFrame, base: str, name: str = "name", mean: str = "mean_ms") -> DataFrame:
    """(name, speed_up): the base's mean over each other's, to two digits; null where either isn't positive. stats is small: a row for each variant."""
    slow = F.max(F.when(F.col(name) == base, F.col(mean))).over(Window.partitionBy(F.lit(1)))
    return stats.withColumn("_hz_base", slow).filter(F.col(name) != base).select(name, F.round(F.when((F.col("_hz_base") > 0) & (F.col(mean) > 0), F.col("_hz_base") / F.col(mean)), 2).alias("speed_up"))


def gaps(groups: DataFrame) -> DataFrame:
    """Per key: largest less smallest rate over non-empty groups (0 below two groups), best and worst group."""
    some = groups.filter("n_frames > 0")
    best = F.max_by("stratum_value", F.struct("detection_rate", F.col("stratum_value")))
    worst = F.min_by("stratum_value", F.struct("detection_rate", F.col("stratum_value")))
    gap = F.max("detection_rate") - F.min("detection_rate")
    return some.groupBy("stratum_key").agg(F.round(F.when(F.count(F.lit(1)) >= 2, gap).otherwise(0.0), 4).alias("gap"), best.alias("best_group"), worst.alias("worst_group"))


def ood_ratio(groups: DataFrame, inside: str, outside: str, key: str = "source") -> DataFrame:
    """Rate outside the training distribution over that inside; 0 if the latter is."""
    rate = lambda v: F.coalesce(F.max(F.when(F.col("stratum_value") == v, F.col("detection_rate"))), F.lit(0.0))
    return groups.filter(F.col("stratum_key") == key).agg(F.round(ratio(rate(outside), rate(inside)), 4).alias("ood_relative_performance"))


def targets_met(metrics: DataFrame, targets=TARGETS) -> DataFrame:
    """(metric, value, target, met) of the metrics that have a target; ``met`` is null for a null value."""
    known = metrics.sparkSession.createDataFrame(list(targets), "metric string, op string, target double")
    v, t = F.col("value"), F.col("target")
    met = F.when(F.col("op") == "<", v < t).when(F.col("op") == "<=", v <= t).when(F.col("op") == ">", v > t).otherwise(v >= t)
    return metrics.join(F.broadcast(known), "metric").select("metric", "value", "target", met.alias("met"))


def overall(judged: DataFrame) -> DataFrame:
    """Whether all targets are met, one row; an unknown metric does not pass."""
    return judged.agg(F.coalesce(F.bool_and(F.coalesce("met", F.lit(False))), F.lit(False)).alias("overall_pass"))


def production_metrics(benchmarks: DataFrame, total_gb: float = 16.0, tokens: int = 200) -> DataFrame:
    """Level 3 in one row from a benchmark row (columns p50_ms, mean_ms, fast_p50_ms, rps, used_gb, agreement, vit_ms)."""
    p50 = F.coalesce(F.nullif("p50_ms", F.lit(0.0)), F.nullif("mean_ms", F.lit(0.0)))
    return benchmarks.select(
        p50.alias("latency_t4_p50_ms"), F.coalesce(F.nullif("fast_p50_ms", F.lit(0.0)), p50).alias("latency_a100_p50_ms"), F.col("rps").alias("throughput_a100_fps"),
        (F.col("rps") * tokens).alias("tokens_per_second"), F.col("used_gb").alias("vram_t4_gb"), (F.lit(total_gb) - F.col("used_gb")).alias("headroom_gb"),
        F.round((1 - F.col("agreement")) * 100, 3).alias("quant_degradation_pct"), F.col("vit_ms").alias("vit_tensorrt_latency_ms"),
    )


def degradation(before: Column, after: Column) -> Column:
    """Loss in percent, 0 without a positive start."""
    return F.when(before > 0, F.round((before - after) / before * 100, 3)).otherwise(0.0)


def nested_metrics(df: DataFrame) -> DataFrame:
    """(metric, value) of rows with nested structs of numbers, named a/b/c by their fields; nulls, texts, arrays and maps are left out."""
    from pyspark.sql.types import BooleanType, NumericType, StructType

    found: list[tuple[str, str]] = []

    def walk(fields, name: str, path: str) -> None:
        for field in fields:
            if isinstance(field.dataType, StructType):
                walk(field.dataType.fields, f"{name}{field.name}/", f"{path}`{field.name}`.")
            elif isinstance(field.dataType, (NumericType, BooleanType)):
                found.append((name + field.name, f"{path}`{field.name}`"))

    walk(df.schema.fields, "", "")
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(p).cast("double").alias("value")) for n, p in found])
    return df.select(F.inline(rows)).filter("value IS NOT NULL")


def report(*tables: tuple[str, DataFrame]) -> DataFrame:
    """One tidy table (level, metric, value) of one-row metric tables."""
    def tidy(level: str, df: DataFrame) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns])
        return df.select(F.inline(rows))

    return reduce(DataFrame.unionByName, [tidy(*t) for t in tables])
