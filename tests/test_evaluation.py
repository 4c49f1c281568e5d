import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardry.operators import evaluation, matching, quality

HAZARDS = "array<struct<bbox_2d: array<double>, label: string, severity: string>>"


def _h(box, label="jaywalking", severity="high"):
    return ([float(v) for v in box], label, severity)


A, B, FAR = (0, 0, 100, 100), (200, 200, 300, 300), (500, 500, 600, 600)


def _run(spark, predictions, truth):
    p = spark.createDataFrame(predictions, f"frame_id string, hazards {HAZARDS}, parse_failure boolean")
    t = spark.createDataFrame([(*row, k) for k, row in enumerate(truth)], f"frame_id string, hazards {HAZARDS}, ord int")
    pairs = evaluation.paired(p, t)
    found = evaluation.events(pairs)
    return evaluation.detection_metrics(pairs, found).first(), found


def test_recall_of_two_in_three(spark):
    row, _ = _run(spark, [("f", [_h(A), _h(B)], False)], [("f", [_h(A), _h(B), _h(FAR)])])
    assert row.hazard_detection_rate == pytest.approx(0.6667) and row.precision == 1 and row.false_negatives == 1


def test_frames_without_hazards(spark):
    row, _ = _run(spark, [("f", [_h(A)], False), ("g", [_h(A, "no_hazard")], False)], [("f", [_h(A, "no_hazard")]), ("g", [])])
    assert row.false_positive_rate == 0.5 and row.true_negatives == 1 and row.no_hazard_accuracy == 0.5


def test_failures_and_missing_truth(spark):
    row, found = _run(spark, [("f", [], True), ("g", [_h(A)], False)], [("f", [_h(A)]), ("x", [_h(A)])])
    assert (row.parse_failure_rate, row.false_negatives, row.total_gt_hazards, row.false_positives) == (0.5, 1, 0, 1)
    assert {r.kind for r in found.collect()} == {"fn", "fp"}


def test_last_truth_wins_and_labels(spark):
    row, found = _run(spark, [("f", [_h(A, "high_density", "low"), _h(B)], False)], [("f", []), ("f", [_h(A), _h(B)])])
    assert row.classification_accuracy == 0.5 and row.true_positives == 2
    by = {r.label: r for r in evaluation.class_metrics(found).collect()}
    assert len(by) == 8 and by["jaywalking"]["count"] == 2 and by["high_density"]["count"] == 0
    sev = evaluation.severity_metrics(found).first()
    assert sev.severity_accuracy == 0.5 and sev.severity_within_one == 0.5 and sev.severity_spearman == 0.0


def test_optimal_beats_greedy():
    w = np.array([[0.9, 0.8], [0.8, 0.1]])
    assert matching.assign(w) == [(0, 1), (1, 0)] and matching.greedy(w) == [(0, 0), (1, 1)]


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms())
def test_assignment_against_brute_force(n, m, rng):
    w = np.array([[rng.randrange(0, 5) / 4 for _ in range(m)] for _ in range(n)])
    pairs = matching.assign(w)
    small = w if n <= m else w.T
    best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert sum(w[i, j] for i, j in pairs) == pytest.approx(best) and best >= sum(w[i, j] for i, j in matching.greedy(w)) - 1e-9


def test_spearman(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int")
    assert evaluation.spearman(rows, "a", "b").first().spearman == 1.0
    assert evaluation.spearman(rows.limit(2), "a", "b").first().spearman == 0.0


def test_judges(spark):
    rows = spark.createDataFrame([("x", d, s) for d, s in zip("abc", (4, 4, 4))] + [("y", d, s) for d, s in zip("abc", (4, 2, 4))], "frame_id string, dimension string, score int")
    assert evaluation.judge_summary(rows).first().pass_rate == 0.5
    by = {r.dimension: r for r in evaluation.judge_stats(rows).collect()}
    assert by["b"]["mean"] == 3.0 and by["b"].n2 == 1 and by["b"]["std"] == 1.0


def test_latency(spark):
    row = evaluation.latency_stats(spark.range(1, 101).selectExpr("cast(id AS double) AS v"), "v").first()
    assert (row.p50_ms, row.p95_ms, row.p99_ms) == (50.5, 95.05, 99.01)
    none = evaluation.latency_stats(spark.range(0).selectExpr("cast(id AS double) AS v"), "v").first()
    assert (none.n, none.mean_ms, none.p50_ms, none.throughput_serial_rps) == (0, 0.0, 0.0, 0.0)


def test_gaps_and_ood(spark):
    rows = spark.createDataFrame([("time", "day", 3, 0.9), ("time", "night", 2, 0.7), ("one", "x", 1, 0.5), ("source", "in", 3, 0.8), ("source", "out", 2, 0.4)], "stratum_key string, stratum_value string, n_frames long, detection_rate double")
    by = {r.stratum_key: r for r in evaluation.gaps(rows).collect()}
    assert by["time"].gap == 0.2 and by["time"].best_group == "day" and by["one"].gap == 0.0
    assert evaluation.ood_ratio(rows, "in", "out").first().ood_relative_performance == 0.5
    assert evaluation.ood_ratio(rows, "none", "out").first().ood_relative_performance == 0.0


def test_targets(spark):
    rows = spark.createDataFrame([("latency_t4_p50_ms", 500.0), ("throughput_a100_fps", 8.0), ("weather_gap", None)], "metric string, value double")
    judged = evaluation.targets_met(rows)
    assert {r.metric: r.met for r in judged.collect()} == {"latency_t4_p50_ms": False, "throughput_a100_fps": True, "weather_gap": None}
    assert evaluation.overall(judged).first().overall_pass is False


def test_text_quality(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("abcd", "abxde"), ("", ""), ("a", "")], "a string, b string")
    assert [r.s for r in rows.select(quality.text_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [pytest.approx(0.6), 1.0, 0.0]
    boxes = spark.createDataFrame([('"bbox_2d": [1, 2, 3, 4] "bbox_2d": [x]', '"bbox_2d": [2, 2, 3, 8] "bbox_2d": [1]')], "a string, b string")
    assert quality.box_error(boxes, "a", "b").first().bbox_mae == 1.25


def test_early_stop(spark):
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 1.0])], "run string, step int, loss double")
    row = quality.early_stop(rows, "loss", ["run"], "step", patience=3).first()
    assert (row.best, row.stopped_at) == (4.0, 4)


def test_judging(spark):
    from hazardry.operators import judging

    p = spark.createDataFrame([("f", [_h(A)], False)], f"frame_id string, hazards {HAZARDS}, parse_failure boolean")
    t = spark.createDataFrame([("f", [_h(B)], 0)], f"frame_id string, hazards {HAZARDS}, ord int")
    asked = judging.prompts(evaluation.paired(p, t))

    def client(prompt):
        if "dimension: completeness" in prompt:
            raise RuntimeError("down")
        return 'Well:\n```json\n{"score": 5, "justification": "x"}\n```' if "correctness" in prompt else '"score": 3'

    assert {r.dimension: r.score for r in judging.ask_judge(asked, client, 2).collect()} == {"correctness": 5, "completeness": 1, "action_relevance": 3}
    texts = spark.createDataFrame([(0, "a"), (1, "")], "ord long, text string")
    assert [r.text for r in judging.calibration_texts(texts, 3).collect()][0] == "a" and judging.calibration_texts(texts, 3).count() == 3


def test_text_similarity_takes_whole_texts(spark, tmp_path):
    from hazardry.plans import registry

    texts = ["a" * 300, "a" * 200 + "b" * 100, "a" * 200 + "b" * 300, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.similarity for r in registry.queries()["text_similarity"](spark, str(tmp_path)).collect()}
    assert got == {0: pytest.approx(200 / 300, abs=1e-6), 1: 0.6, 2: 0.0}
