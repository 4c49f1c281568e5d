"""Queries of matching and the four levels of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardry.operators import evaluation, judging, matching, quality
from hazardry.operators.annotation import LABELS
from hazardry.plans.adapters import BOXES_SQL, embedded_boxes, labelled_documents, micros, table
from hazardry.plans.registry import query


def _hazards(box: str, shift: int):
    """One hazard of an embedding's box; label and severity by arithmetic."""
    label = F.when(F.pmod(F.col("vec_id") + shift, F.lit(7)) == 0, "no_hazard").when(F.pmod("vec_id", F.lit(3)) == 0, "jaywalking").when(F.pmod("vec_id", F.lit(3)) == 1, "high_density").otherwise("unusual_object")
    severity = F.element_at(F.array(*[F.lit(s) for s in evaluation.SEVERITY]), F.pmod(F.col("vec_id") + shift, F.lit(4)).cast("int") + 1)
    return F.struct(F.col(box).alias("bbox_2d"), label.alias("label"), severity.alias("severity"))


def _frames(spark, sf_dir):
    """Groups of four embeddings as frames: box a is predicted, box b true."""
    rows = embedded_boxes(spark, sf_dir).withColumn("frame_id", F.floor(F.col("vec_id") / 4).cast("string"))
    near = F.when(F.pmod("vec_id", F.lit(2)) == 0, F.transform("a", lambda v: v + 5.0)).otherwise(F.col("b"))
    rows = rows.withColumn("b", near)
    grouped = rows.groupBy("frame_id").agg(
        F.array_sort(F.collect_list(_hazards("a", 0))).alias("hazards"), F.array_sort(F.collect_list(_hazards("b", 1))).alias("true_hazards"),
        (F.pmod(F.max("vec_id"), F.lit(20)) == 3).alias("parse_failure"),
    )
    predictions = grouped.select("frame_id", "hazards", "parse_failure")
    truth = grouped.select("frame_id", F.col("true_hazards").alias("hazards"), F.lit(0).alias("ord"))
    return predictions, truth


def _matched(spark, sf_dir):
    pairs = evaluation.paired(*_frames(spark, sf_dir))
    return pairs, evaluation.events(pairs)


_CROSS = BOXES_SQL + """, p AS (SELECT floor(vec_id / 4)::BIGINT AS frame_id, vec_id AS pred_idx, ax1, ay1, ax2, ay2 FROM boxes), t AS (SELECT floor(vec_id / 4)::BIGINT AS frame_id, vec_id AS true_idx, bx1, by1, bx2, by2 FROM boxes),
j AS (SELECT p.*, true_idx, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) AS s, t.* EXCLUDE (frame_id, true_idx) FROM p JOIN t ON p.frame_id = t.frame_id)
"""


@query("box_overlaps", _CROSS + "SELECT frame_id, pred_idx, true_idx, round(i / (s - i), 6) AS iou FROM j")
def box_overlaps(spark, sf_dir):
    rows = embedded_boxes(spark, sf_dir).withColumn("frame_id", F.floor(F.col("vec_id") / 4))
    sides = [rows.select("frame_id", F.col("vec_id").alias("idx"), F.col(c).alias("box")) for c in ("a", "b")]
    return matching.overlaps(*sides).withColumn("iou", F.round("iou", 6))


def _side_sql(kind: str, shift: int, box: str) -> str:
    """Hazards of one side but those labelled no_hazard, numbered within their frame."""
    return f"""{kind} AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY vec_id) AS i FROM (
    SELECT vec_id // 4 AS f, vec_id, {box},
           CASE WHEN (vec_id + {shift}) % 7 = 0 THEN 'no_hazard' WHEN vec_id % 3 = 0 THEN 'jaywalking' WHEN vec_id % 3 = 1 THEN 'high_density' ELSE 'unusual_object' END AS label,
           ['low', 'medium', 'high', 'critical'][(vec_id + {shift}) % 4 + 1] AS severity
    FROM boxes) WHERE label <> 'no_hazard'
)"""


_NEAR = ", ".join(f"CASE WHEN vec_id % 2 = 0 THEN a{c} + 5.0 ELSE b{c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))
#: The assignment of largest total overlap among all 24 ways to pair up to four boxes with up to four.
_EVENTS = BOXES_SQL + f""", {_side_sql("pr", 0, "ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2")}, {_side_sql("tr", 1, _NEAR)},
fr AS (SELECT vec_id // 4 AS f, max(vec_id) % 20 = 3 AS failed FROM boxes GROUP BY 1),
ov AS (SELECT p.f, p.i, t.i AS j, greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS s, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS u FROM pr p JOIN tr t ON t.f = p.f),
iou AS (SELECT f, i, j, s / (u - s) AS v FROM ov JOIN fr USING (f) WHERE NOT failed),
ways AS (SELECT [a, b, c, d] AS w FROM (SELECT unnest(range(1, 5)) AS a), (SELECT unnest(range(1, 5)) AS b), (SELECT unnest(range(1, 5)) AS c), (SELECT unnest(range(1, 5)) AS d) WHERE len(list_distinct([a, b, c, d])) = 4),
best AS (SELECT f, arg_max(w, total) AS w FROM (SELECT f, w, sum(CASE WHEN w[i] = j THEN v ELSE 0 END) AS total FROM iou, ways GROUP BY 1, 2) GROUP BY 1),
met AS (SELECT f, i, j, v FROM iou JOIN best USING (f) WHERE w[i] = j AND v >= 0.5),
found AS (
  SELECT m.f, 'tp' AS kind, p.label AS pred_label, t.label AS true_label, p.severity AS pred_severity, t.severity AS true_severity, v AS iou FROM met m JOIN pr p ON p.f = m.f AND p.i = m.i JOIN tr t ON t.f = m.f AND t.i = m.j
  UNION ALL SELECT p.f, 'fp', p.label, NULL, p.severity, NULL, NULL FROM pr p JOIN fr USING (f) WHERE NOT failed AND NOT EXISTS (FROM met m WHERE m.f = p.f AND m.i = p.i)
  UNION ALL SELECT t.f, 'fn', NULL, t.label, NULL, t.severity, NULL FROM tr t WHERE NOT EXISTS (FROM met m WHERE m.f = t.f AND m.j = t.i)
)
"""


def _ratio_sql(over: str, under: str) -> str:
    return f"(CASE WHEN {under} > 0 THEN ({over})::DOUBLE / ({under}) ELSE 0.0 END)"


@query("hazard_matches", _EVENTS + "SELECT f::VARCHAR AS frame_id, kind, pred_label, true_label, pred_severity, true_severity, round(iou, 6) AS iou FROM found")
def hazard_matches(spark, sf_dir):
    return _matched(spark, sf_dir)[1].drop("pred_row").withColumn("iou", F.round("iou", 6))


_PRECISION, _RECALL = _ratio_sql("tp", "tp + fp"), _ratio_sql("tp", "tp + fn")


@query(
    "grounding_metrics",
    _EVENTS + f""", z AS (SELECT f, failed, (SELECT count(*) FROM pr WHERE pr.f = fr.f) AS np, (SELECT count(*) FROM tr WHERE tr.f = fr.f) AS nt FROM fr),
    c AS (SELECT count(*) AS total_frames, count(*) FILTER (failed) AS parse_failures, count(*) FILTER (NOT failed AND nt = 0 AND np = 0) AS true_negatives, count(*) FILTER (NOT failed AND nt = 0 AND np > 0) AS fp_frames,
                 coalesce(sum(nt) FILTER (NOT failed), 0)::BIGINT AS total_gt_hazards, coalesce(sum(np) FILTER (NOT failed), 0)::BIGINT AS total_pred_hazards FROM z),
    k AS (SELECT count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, coalesce(avg(iou), 0.0) AS iou, count(*) FILTER (kind = 'tp' AND pred_label IS NOT DISTINCT FROM true_label) AS same FROM found)
    SELECT round({_ratio_sql("tp", "tp + fp + fn")}, 4) AS iou_at_threshold, round({_RECALL}, 4) AS hazard_detection_rate, round({_ratio_sql("fp_frames", "true_negatives + fp_frames")}, 4) AS false_positive_rate, round({_PRECISION}, 4) AS precision,
           round({_ratio_sql(f"2 * {_PRECISION} * {_RECALL}", f"{_PRECISION} + {_RECALL}")}, 4) AS f1_score, round(iou, 4) AS mean_iou, round({_ratio_sql("same", "tp")}, 4) AS classification_accuracy,
           total_frames, total_gt_hazards, total_pred_hazards, tp AS true_positives, fp AS false_positives, fn AS false_negatives, true_negatives,
           round({_ratio_sql("true_negatives", "true_negatives + fp_frames")}, 4) AS no_hazard_accuracy, round({_ratio_sql("parse_failures", "total_frames")}, 4) AS parse_failure_rate, parse_failures FROM c, k""",
)
def grounding_metrics(spark, sf_dir):
    return evaluation.detection_metrics(*_matched(spark, sf_dir))


@query(
    "grounding_class_metrics",
    _EVENTS + f""", l AS (SELECT unnest([{", ".join(f"'{x}'" for x in LABELS[:-1])}]) AS label),
    k AS (SELECT l.label, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM l LEFT JOIN found ON l.label = CASE WHEN kind = 'fp' THEN pred_label ELSE true_label END GROUP BY 1)
    SELECT label, round({_PRECISION}, 4) AS precision, round({_RECALL}, 4) AS recall, round({_ratio_sql(f"2 * {_PRECISION} * {_RECALL}", f"{_PRECISION} + {_RECALL}")}, 4) AS f1, tp + fn AS count FROM k""",
)
def grounding_class_metrics(spark, sf_dir):
    return evaluation.class_metrics(_matched(spark, sf_dir)[1])


@query(
    "grounding_severity",
    _EVENTS + """, s AS (SELECT list_position(['low', 'medium', 'high', 'critical'], pred_severity) AS p, list_position(['low', 'medium', 'high', 'critical'], true_severity) AS t FROM found WHERE kind = 'tp'),
    r AS (SELECT p, t, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt FROM s)
    SELECT round(coalesce(avg((p = t)::INTEGER), 0.0), 4) AS severity_accuracy, round(coalesce(avg((abs(p - t) <= 1)::INTEGER), 0.0), 4) AS severity_within_one,
           round(CASE WHEN count(*) >= 3 AND stddev_pop(rp) > 0 AND stddev_pop(rt) > 0 THEN corr(rp, rt) ELSE 0.0 END, 4) AS severity_spearman FROM r""",
)
def grounding_severity(spark, sf_dir):
    return evaluation.severity_metrics(_matched(spark, sf_dir)[1])


_LABELLED = "WITH x AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id) "


@query("confusion_matrix", _LABELLED + "SELECT quality, toxic, count(*) AS count FROM x GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(labelled_documents(spark, sf_dir), "quality", "toxic")


def _kinds(spark, sf_dir):
    """Labels as detections: quality is the truth, toxic the prediction, language the class."""
    rows = labelled_documents(spark, sf_dir)
    label = F.element_at(F.create_map(*[F.lit(v) for kv in (("en", "jaywalking"), ("de", "high_density"), ("fr", "unusual_object"), ("es", "construction_zone")) for v in kv]), F.col("lang"))
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "tp").when(F.col("toxic") == 1, "fp").when(F.col("quality") == 1, "fn")
    return rows.select("doc_id", kind.alias("kind"), label.alias("true_label"), label.alias("pred_label")).filter("kind IS NOT NULL")


@query(
    "class_metrics",
    _LABELLED + """, k AS (SELECT CASE lang WHEN 'en' THEN 'jaywalking' WHEN 'de' THEN 'high_density' WHEN 'fr' THEN 'unusual_object' WHEN 'es' THEN 'construction_zone' END AS label,
      count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM x GROUP BY 1),
    d AS (SELECT unnest(['occluded_pedestrian', 'jaywalking', 'cyclist_proximity', 'construction_zone', 'adverse_weather', 'unusual_object', 'emergency_vehicle', 'high_density']) AS label),
    m AS (SELECT d.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM d LEFT JOIN k ON k.label = d.label),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS q FROM m)
    SELECT label, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1, tp + fn AS count FROM r""",
)
def class_metrics(spark, sf_dir):
    return evaluation.class_metrics(_kinds(spark, sf_dir))


@query(
    "detection_metrics",
    _LABELLED + """, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS fn,
      count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS tn FROM x)
    SELECT round(tp / (tp + fp + fn), 4) AS iou_at_threshold, round(tp / (tp + fn), 4) AS hazard_detection_rate, round(fp / (fp + tn), 4) AS false_positive_rate, round(tp / (tp + fp), 4) AS precision,
           round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1_score, round(tn / (fp + tn), 4) AS no_hazard_accuracy FROM c""",
)
def detection_metrics(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    n = lambda c: F.count(F.when(c, 1))
    counts = labelled_documents(spark, sf_dir).agg(
        n(q & t).alias("tp"), n(~q & t).alias("fp"), n(q & ~t).alias("fn"), n(~q & ~t).alias("true_negatives"), n(~q & t).alias("fp_frames"), F.lit(0.0).alias("iou"), n(q & t).alias("same"),
        F.count(F.lit(1)).alias("total_frames"), n(q).alias("total_gt_hazards"), n(t).alias("total_pred_hazards"), F.lit(0).alias("parse_failures"),
    )
    return evaluation.rates(counts).select("iou_at_threshold", "hazard_detection_rate", "false_positive_rate", "precision", "f1_score", "no_hazard_accuracy")


@query(
    "severity_agreement",
    _LABELLED + ", s AS (SELECT (quality * 2 + doc_id % 2 + 1) AS p, (toxic + doc_id % 3 + 1) AS t FROM x) SELECT round(avg((p = t)::INTEGER), 4) AS exact, round(avg((abs(p - t) <= 1)::INTEGER), 4) AS within_one FROM s",
)
def severity_agreement(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in evaluation.SEVERITY])
    pick = lambda c: F.element_at(names, c.cast("int"))
    rows = labelled_documents(spark, sf_dir).select(
        F.lit("tp").alias("kind"), pick(F.col("quality") * 2 + F.pmod("doc_id", F.lit(2)) + 1).alias("pred_severity"), pick(F.col("toxic") + F.pmod("doc_id", F.lit(3)) + 1).alias("true_severity")
    )
    return evaluation.severity_metrics(rows).select(F.col("severity_accuracy").alias("exact"), F.col("severity_within_one").alias("within_one"))


@query(
    "spearman",
    _LABELLED + """, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0::DOUBLE AS b FROM x)
    SELECT count(*) AS n, round(corr(a, b), 4) AS spearman FROM r""",
)
def spearman(spark, sf_dir):
    return evaluation.spearman(labelled_documents(spark, sf_dir).select("n_chars", "toxic"), "n_chars", "toxic")


_SCORES = """
WITH s AS (SELECT conv_id AS frame_id, d AS dimension, (('0x' || substr(md5('42:' || conv_id::VARCHAR || ':' || d), 1, 8))::BIGINT % 3 + 3)::INTEGER AS score
  FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['correctness', 'completeness', 'action_relevance']) AS d))
"""


def _scores(spark, sf_dir):
    return evaluation.template_scores(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("frame_id")).distinct())


@query(
    "judge_stats",
    _SCORES + "SELECT dimension, round(avg(score), 4) AS mean, round(quantile_cont(score::DOUBLE, 0.5), 4) AS median, round(stddev_pop(score), 4) AS std, " + ", ".join(f"count(*) FILTER (WHERE score = {k}) AS n{k}" for k in range(1, 6)) + " FROM s GROUP BY 1",
)
def judge_stats(spark, sf_dir):
    return evaluation.judge_stats(_scores(spark, sf_dir))


@query(
    "judge_summary",
    _SCORES + ", f AS (SELECT frame_id, bool_and(score >= 3.5) AS ok, sum(score) AS s, count(*) AS n FROM s GROUP BY 1) SELECT count(*) AS frames, round(sum(s)::DOUBLE / sum(n), 4) AS overall_mean, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 4) AS pass_rate FROM f",
)
def judge_summary(spark, sf_dir):
    return evaluation.judge_summary(_scores(spark, sf_dir))


@query(
    "judge_pairs",
    "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 0",
)
def judge_pairs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id", "quality"), "doc_id")


_LATENCY = """count(value) AS n, round(avg(value), 2) AS mean_ms, round(quantile_cont(value::DOUBLE, 0.5), 2) AS p50_ms, round(quantile_cont(value::DOUBLE, 0.95), 2) AS p95_ms, round(quantile_cont(value::DOUBLE, 0.99), 2) AS p99_ms,
  round(CASE WHEN sum(value) > 0 THEN count(value) / (sum(value) / 1000) ELSE 0 END, 4) AS throughput_serial_rps, round(CASE WHEN avg(value) > 0 THEN 1000 / avg(value) ELSE 0 END, 1) AS fps"""


@query("latency_stats", f"SELECT event_type, {_LATENCY} FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    return evaluation.latency_stats(table(spark, sf_dir, "events"), "value", "event_type")


@query("throughput", "SELECT event_type, round(count(*)::DOUBLE / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE), 8) AS wall_rps FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", micros(F.col("ts")).alias("t"))
    return rows.groupBy("event_type").agg(F.round(F.count(F.lit(1)) / ((F.max("t") - F.min("t")) / 1_000_000.0), 8).alias("wall_rps"))


_STRATA = _LABELLED + """, c AS (SELECT *, (quality = 1 AND toxic = 0)::INTEGER AS tp, (quality = 0 OR toxic = 1)::INTEGER AS fn, CASE WHEN n_chars / 100.0 < 20 THEN '0-20' WHEN n_chars / 100.0 < 40 THEN '20-40' ELSE '40+' END AS speed FROM x),
u AS (SELECT 'lang' AS stratum_key, lang AS stratum_value, tp, fn FROM c UNION ALL SELECT 'source', source, tp, fn FROM c UNION ALL SELECT 'speed', speed, tp, fn FROM c),
g AS (SELECT stratum_key, stratum_value, count(*) AS n_frames, round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp)::DOUBLE / (sum(tp) + sum(fn)) ELSE 0 END, 4) AS detection_rate FROM u GROUP BY 1, 2)
"""


def _strata(spark, sf_dir):
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = labelled_documents(spark, sf_dir).withColumns({"tp": good.cast("int"), "fn": (~good).cast("int"), "speed": evaluation.speed_bucket(F.col("n_chars") / 100.0)})
    return evaluation.strata(rows, ["lang", "source", "speed"])


@query("strata_metrics", _STRATA + "SELECT * FROM g")
def strata_metrics(spark, sf_dir):
    return _strata(spark, sf_dir)


@query(
    "condition_gap",
    _STRATA + """SELECT stratum_key, round(CASE WHEN count(*) >= 2 THEN max(detection_rate) - min(detection_rate) ELSE 0 END, 4) AS gap,
      first(stratum_value ORDER BY detection_rate DESC, stratum_value DESC) AS best_group, first(stratum_value ORDER BY detection_rate, stratum_value) AS worst_group FROM g GROUP BY 1""",
)
def condition_gap(spark, sf_dir):
    return evaluation.gaps(_strata(spark, sf_dir))


@query("ood_ratio", _STRATA + "SELECT round(coalesce(max(CASE WHEN stratum_value = 'src1' THEN detection_rate END), 0) / nullif(max(CASE WHEN stratum_value = 'src2' THEN detection_rate END), 0), 4) AS ood_relative_performance FROM g WHERE stratum_key = 'source'")
def ood_ratio(spark, sf_dir):
    return evaluation.ood_ratio(_strata(spark, sf_dir), "src2", "src1")


_TARGETS = "(VALUES " + ", ".join(f"('{m}', '{o}', {v}::DOUBLE)" for m, o, v in evaluation.TARGETS) + ") t(metric, op, target)"


@query(
    "targets_met",
    f"""WITH m AS (SELECT metric, (k * 0.04)::DOUBLE AS value FROM (SELECT metric, row_number() OVER (ORDER BY metric) AS k FROM {_TARGETS}))
    SELECT m.metric, value, target, CASE op WHEN '<' THEN value < target WHEN '<=' THEN value <= target ELSE value >= target END AS met FROM m JOIN {_TARGETS} ON t.metric = m.metric""",
)
def targets_met(spark, sf_dir):
    names = sorted(m for m, _, _ in evaluation.TARGETS)
    return evaluation.targets_met(spark.createDataFrame([(m, float(f"{(k + 1) * 0.04:.2f}")) for k, m in enumerate(names)], "metric string, value double"))


@query(
    "overall_pass",
    f"""WITH m AS (SELECT metric, (k * 0.04)::DOUBLE AS value FROM (SELECT metric, row_number() OVER (ORDER BY metric) AS k FROM {_TARGETS}))
    SELECT bool_and(CASE op WHEN '<' THEN value < target WHEN '<=' THEN value <= target ELSE value >= target END) AS overall_pass FROM m JOIN {_TARGETS} ON t.metric = m.metric""",
)
def overall_pass(spark, sf_dir):
    return evaluation.overall(targets_met(spark, sf_dir))


@query(
    "production_metrics",
    """WITH b AS (SELECT quantile_cont(value::DOUBLE, 0.5) AS p50, count(*) / (sum(value) / 1000) AS rps, avg(value) AS m FROM events)
    SELECT round(p50, 6) AS latency_t4_p50_ms, round(p50, 6) AS latency_a100_p50_ms, round(rps, 6) AS throughput_a100_fps, round(rps * 200, 6) AS tokens_per_second, 5.5::DOUBLE AS vram_t4_gb, 10.5::DOUBLE AS headroom_gb, 2.0::DOUBLE AS quant_degradation_pct,
           round(m, 6) AS vit_tensorrt_latency_ms FROM b""",
)
def production_metrics(spark, sf_dir):
    row = table(spark, sf_dir, "events").agg(
        F.percentile("value", 0.5).alias("p50_ms"), F.avg("value").alias("mean_ms"), F.lit(0.0).alias("fast_p50_ms"), (F.count(F.lit(1)) / (F.sum("value") / 1000)).alias("rps"),
        F.lit(5.5).alias("used_gb"), F.lit(0.98).alias("agreement"), F.avg("value").alias("vit_ms"),
    )
    out = evaluation.production_metrics(row)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("evaluation_report", _STRATA + "SELECT 'strata' AS level, 'groups' AS metric, count(*)::DOUBLE AS value FROM g UNION ALL SELECT 'strata', 'frames', sum(n_frames)::DOUBLE FROM g UNION ALL SELECT 'labels', 'rows', (SELECT count(*) FROM labels)::DOUBLE")
def evaluation_report(spark, sf_dir):
    return evaluation.report(
        ("strata", _strata(spark, sf_dir).agg(F.count(F.lit(1)).alias("groups"), F.sum("n_frames").alias("frames"))), ("labels", table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("rows")))
    )


@query("quant_degradation", "SELECT p_partkey, CASE WHEN p_retailprice - 950 > 0 THEN round((p_retailprice - 950 - p_size) / (p_retailprice - 950) * 100, 3) ELSE 0 END AS degradation FROM part")
def quant_degradation(spark, sf_dir):
    before = F.col("p_retailprice") - 950
    return table(spark, sf_dir, "part").select("p_partkey", evaluation.degradation(before, F.col("p_size")).alias("degradation"))


@query(
    "text_similarity",
    """WITH p AS (SELECT o.doc_id, o.text AS a, n.text AS b FROM documents o JOIN documents n ON n.doc_id = o.doc_id + 1),
    c AS (SELECT doc_id, a, b, len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] = x[2])) AS same FROM p)
    SELECT doc_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE same::DOUBLE / greatest(length(a), length(b)) END, 6) AS similarity FROM c""",
)
def text_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    met = quality.zipped(docs, docs.withColumn("ord", F.col("ord") - 1))
    return met.select(F.col("ord").alias("doc_id"), F.round(quality.text_similarity(F.col("text_a"), F.col("text_b")), 6).alias("similarity"))


def _outputs(spark, sf_dir):
    n = lambda m, k=0: F.pmod(F.col("event_id") + k, F.lit(m)).cast("string")
    raw = lambda k: F.concat(F.lit('{"bbox_2d": ['), n(50, k), F.lit(", "), n(70), F.lit(', 300, '), F.when(F.pmod("event_id", F.lit(11)) == 0, "x").otherwise("400"), F.lit('], "label": "l'), n(3, k), F.lit('"} {"label": "l'), n(2), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", raw(0).alias("a"), raw(7).alias("b"))


@query("bbox_mae", "SELECT 4 * count(*) AS n, round(sum(abs(event_id % 50 - (event_id + 7) % 50))::DOUBLE / (4 * count(*)), 4) AS bbox_mae FROM events WHERE event_id % 11 <> 0")
def bbox_mae(spark, sf_dir):
    return quality.box_error(_outputs(spark, sf_dir), "a", "b")


@query(
    "label_agreement",
    "SELECT event_id, list_sort(list_distinct([event_id % 3, event_id % 2])) = list_sort(list_distinct([(event_id + 7) % 3, event_id % 2])) AS agree FROM events",
)
def label_agreement(spark, sf_dir):
    return _outputs(spark, sf_dir).select("event_id", quality.labels_agree(F.col("a"), F.col("b")).alias("agree"))


@query(
    "running_stats",
    "SELECT user_id, event_id, round(avg(value) OVER w, 8) AS running_mean, min(value) OVER w AS running_min FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
)
def running_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return quality.running(rows, "value", ["user_id"], ["event_id"], digits=8).select("user_id", "event_id", "running_mean", "running_min")


@query(
    "early_stops",
    """WITH e AS (SELECT user_id, event_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
                      min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events),
    g AS (SELECT *, max(CASE WHEN m IS NULL OR v < m THEN r END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM e),
    s AS (SELECT user_id, min(event_id) AS stop FROM g WHERE r - last >= 5 GROUP BY 1)
    SELECT user_id, min(v) AS best, any_value(stop) AS stopped_at FROM e LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY 1""",
)
def early_stops(spark, sf_dir):
    return quality.early_stop(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", ["user_id"], "event_id", patience=5)


@query("prediction_summary", "SELECT count(*) AS total, round(avg((event_type <> 'error')::INTEGER), 4) AS parse_rate, round(avg(value), 1) AS avg_ms FROM events")
def prediction_summary(spark, sf_dir):
    return quality.prediction_summary(table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("parse_success"), F.col("value").alias("generation_time_ms")))


@query(
    "speed_ups",
    "WITH m AS (SELECT event_type AS name, avg(value) AS mean_ms FROM events GROUP BY 1) SELECT name, round((SELECT mean_ms FROM m WHERE name = 'click') / mean_ms, 2) AS speed_up FROM m WHERE name <> 'click'",
)
def speed_ups(spark, sf_dir):
    stats = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("mean_ms"))
    return evaluation.speed_ups(stats, "click")


@query(
    "stratified_detection",
    _EVENTS + f""", z AS (SELECT f, unnest(['time_of_day', 'weather']) AS stratum_key, unnest([CASE WHEN f % 2 = 0 THEN 'day' ELSE 'night' END, CASE WHEN f % 5 = 0 THEN 'rain' ELSE 'clear' END]) AS stratum_value FROM fr),
    k AS (SELECT f, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fn') AS fn FROM found GROUP BY 1)
    SELECT stratum_key, stratum_value, count(*) AS n_frames, round({_ratio_sql("coalesce(sum(tp), 0)", "coalesce(sum(tp + fn), 0)")}, 4) AS detection_rate FROM z LEFT JOIN k USING (f) GROUP BY 1, 2""",
)
def stratified_detection(spark, sf_dir):
    predictions, truth = _frames(spark, sf_dir)
    parts = {"time_of_day": F.when(F.pmod(F.col("frame_id").cast("int"), F.lit(2)) == 0, "day").otherwise("night"), "weather": F.when(F.pmod(F.col("frame_id").cast("int"), F.lit(5)) == 0, "rain").otherwise("clear")}
    return evaluation.stratified(predictions, truth.withColumns(parts), list(parts))


@query("judged_pairs")
def judged_pairs(spark, sf_dir):
    pairs = evaluation.paired(*_frames(spark, sf_dir)).filter("NOT parse_failure")
    return judging.ask_judge(judging.prompts(pairs), lambda prompt: f'{{"score": {len(prompt) % 5 + 1}}}').select("frame_id", "dimension", "score")


@query("calibration_texts", "SELECT ord, text FROM (SELECT s_suppkey AS ord, s_name AS text FROM supplier UNION ALL SELECT r + 1099511627776, CASE WHEN r % 2 = 0 THEN 'Describe the hazards in this scene.' ELSE 'What should the ego vehicle do?' END FROM range(128) t(r)) ORDER BY ord LIMIT 128")
def calibration_texts(spark, sf_dir):
    return judging.calibration_texts(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text")), 128)


@query("model_sizes", "SELECT p_partkey, (p_size * p_size * 4 * 12 + 1000 * p_size)::BIGINT AS parameters, (p_size * 28 // 56)::BIGINT AS grid_rows FROM part")
def model_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit(None).cast("long").alias("num_parameters"), F.col("p_size").alias("hidden_size"), F.lit(12).alias("num_hidden_layers"), F.lit(1000).alias("vocab_size"),
        F.get(judging.patch_grid(F.col("p_size") * 28, F.lit(672), 56), F.lit(1)).alias("grid_rows"),
    )
    return judging.estimated_parameters(rows).select("p_partkey", "parameters", "grid_rows")
