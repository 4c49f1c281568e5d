"""Exports, reports, strata of matches, prediction records and other operators that write or call out, on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from hazardry.functions import geometry, text
from hazardry.operators import annotation, dataset, evaluation
from hazardry.sources import readers, writers
from tests.test_evaluation import HAZARDS, A, B, _h


def test_strata_of_matched_events(spark):
    truth = spark.createDataFrame(
        [("a", [_h(A)], "night", 0), ("a", [_h(A)], "day", 1), ("b", [_h(A), _h(B)], "day", 2), ("c", [_h(A)], "night", 3)], f"frame_id string, hazards {HAZARDS}, time_of_day string, ord int"
    )
    predictions = spark.createDataFrame([("a", [_h(A)], False), ("b", [_h(A)], False), ("orphan", [_h(A)], False)], f"frame_id string, hazards {HAZARDS}, parse_failure boolean")
    got = {r.stratum_value: (r.n_frames, r.detection_rate) for r in evaluation.stratified(predictions, truth, ["time_of_day"]).collect()}
    assert got == {"day": (2, 0.6667), "night": (1, 0.0)}


def test_pairs_do_not_depend_on_partitions(spark):
    truth = spark.createDataFrame([("a", [_h(A)], 0)], f"frame_id string, hazards {HAZARDS}, ord int")
    rows = [("a", [_h(A)], False), ("a", [_h(B)], False), ("a", [_h(A)], False), ("z", [], True)]
    make = lambda k: evaluation.paired(spark.createDataFrame(rows, f"frame_id string, hazards {HAZARDS}, parse_failure boolean").repartition(k), truth)
    one, other = ({r.pred_row: str(r.pred) for r in make(k).collect()} for k in (1, 3))
    assert one == other and len(one) == 4


def test_constant_severities(spark):
    rows = spark.createDataFrame([(1, k) for k in range(5)], "p int, t int")
    assert evaluation.spearman(rows, "p", "t").first().spearman == 0.0
    assert evaluation.spearman(rows, "t", "t").first().spearman == 1.0
    assert evaluation.spearman(rows.limit(0), "p", "t").first().asDict() == {"n": 0, "spearman": 0.0}


def test_speed_ups_and_nested_metrics(spark):
    rows = spark.createDataFrame([("eager", 45.2), ("compiled", 28.7), ("none", 0.0)], "name string, mean_ms double")
    assert {r.name: r.speed_up for r in evaluation.speed_ups(rows, "eager").collect()} == {"compiled": 1.57, "none": None}
    nested = spark.sql("SELECT named_struct('b', named_struct('c', 1, 'd', cast(null as double)), 'e', 'text', 'f', array(1)) AS a, 2.5D AS g, true AS h")
    assert {r.metric: r.value for r in evaluation.nested_metrics(nested).collect()} == {"a/b/c": 1.0, "g": 2.5, "h": 1.0}


def test_diversity(spark):
    found = spark.sql(
        """SELECT * FROM VALUES ('a', named_struct('hazards', array(named_struct('label', 'x', 'severity', 'low'), named_struct('label', 'y', 'severity', 'low')))),
        (null, named_struct('hazards', array(named_struct('label', 'y', 'severity', cast(null as string))))), ('a', null) AS t(source, annotation)"""
    )
    got = {(r.dimension, r.value): r["count"] for r in annotation.diversity(found, most=1).collect()}
    assert got == {("label", "y"): 2, ("severity", "low"): 2, ("severity", ""): 1, ("source", "a"): 2, ("source", "unknown"): 1}


def test_prediction_records(spark):
    schema = "frame_id string, messages array<struct<role: string, content: string>>"
    records = spark.createDataFrame([("f", [("system", "s"), ("user", "u"), ("assistant", "x")]), ("g", [("assistant", "x")]), (None, None)], schema)

    def predictor(messages):
        return '{"n": %d}' % len(messages) if messages[0]["content"] == "s" else messages[-1]["content"]

    got = {r.frame_id: r for r in annotation.predict(records, predictor, 2).collect()}
    assert json.loads(got["f"].parsed_output) == {"n": 2} and got["f"].parse_success and got["f"].generation_time_ms >= 0
    assert got["g"].raw_output == annotation.DEFAULT_REQUEST and got["g"].parsed_output is None and not got["g"].parse_success
    assert len(got) == 3 and any(k.startswith("frame_") for k in got)


def test_served_json(spark):
    rows = spark.createDataFrame([(0, ' [1, 2] '), (1, "x\n```json\n[3]\n```"), (2, 'so {"a": 1} then'), (3, "nothing"), (4, None)], "k int, t string")
    got = {r.k: r.j for r in rows.select("k", text.served_json(F.col("t")).alias("j")).collect()}
    assert [json.loads(got[k]) for k in range(4)] == [[1, 2], [3], {"a": 1}, {"parse_failure": "nothing", "hazards": []}]


def test_random_flips_repeat(spark):
    rows = spark.range(400).select("id", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("b"))
    make = lambda seed: [r.f[0] for r in rows.select("id", geometry.maybe_flipped(F.col("b"), F.lit(10.0), F.col("id"), seed).alias("f")).orderBy("id").collect()]
    one = make(1)
    assert one == make(1) != make(2) and set(one) == {1.0, 7.0} and 140 < one.count(7.0) < 260


def test_image_paths(spark):
    frames = spark.createDataFrame([("a", "images/1.png", "/cam/1.png"), ("b", "/abs/2.png", "/cam/2.png"), ("c", None, "/cam/3.png"), ("d", "", None)], "sample_token string, exported_image_path string, cam_front_path string")
    files = spark.createDataFrame([("/out/images/1.png",), ("/pool/2.png",), ("/pool/9.png",)], "path string")
    paths = dataset.image_paths(frames, files, "/out", "/pool/")
    assert {r.sample_token: r.image for r in paths.collect()} == {"a": "/out/images/1.png", "b": "/pool/2.png", "c": None, "d": None}
    own = spark.createDataFrame([("a", "x"), ("c", "y"), ("q", "z")], "frame_id string, image_path string")
    assert {r.frame_id: r.image_path for r in dataset.with_images(own, paths).collect()} == {"a": "/out/images/1.png", "c": "y", "q": "z"}


def test_splits_of_few_rows_and_null_strata(spark):
    few = spark.range(9).select(F.col("id").alias("k"), F.lit("s").alias("s"))
    assert [r.split for r in dataset.stratified_split(few, "k", ["s"]).orderBy("k").collect()] == ["train"] * 7 + ["test"] * 2
    many = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") < 100, F.lit("s")).alias("s"))
    counts = {(r.s, r.split): r["count"] for r in dataset.stratified_split(many, "k", ["s"]).groupBy("s", "split").count().collect()}
    assert counts == {(s, split): n for s in ("s", None) for split, n in (("train", 80), ("val", 10), ("test", 10))}


def test_exports(spark, tmp_path):
    root = str(tmp_path)
    scored = spark.createDataFrame([("a", 3, 1, "/cam/a.png"), ("b", 1, 0, "/cam/b.png")], "sample_token string, rarity_score int, sig_density int, cam_front_path string")
    copies = writers.filtered(scored, scored.filter("rarity_score >= 3"), f"{root}/f", ["sig_density"]).collect()
    assert [(r.source, r.target) for r in copies] == [("/cam/a.png", f"{root}/f/images/a.png")]
    summary = spark.read.json(f"{root}/f/summary").first()
    assert (summary.total_frames_scanned, summary.frames_exported, summary.filter_rate_pct, summary.signal_breakdown_in_filtered.sig_density) == (2, 1, 50.0, 1)
    assert spark.read.json(f"{root}/f/metadata").first().exported_image_path == "images/a.png"
    key = spark.createDataFrame([("7", "012", 3, "critical", "/i.png")], "category string, sequence string, frame_index int, frame_type string, image_path string")
    assert writers.keyframes(key, f"{root}/k").first().target == f"{root}/k/images/dada_cat07_seq012_frame0003_critical.png"
    frames = spark.createDataFrame([("a", "train"), ("b", "odd"), ("c", "val")], "frame_id string, split string")
    answer = json.dumps({"hazards": [{"bbox_2d": [1, 2, 30, 40], "label": "jaywalking", "severity": "low", "reasoning": "long enough to be accepted here", "action": "brake"}], "scene_summary": "s", "ego_context": {"weather": "x", "time_of_day": "y", "road_type": "z"}})
    found = annotation.results(spark.createDataFrame([("a", answer, "real", 0), ("b", "no", "real", 1), ("a", answer, "counterfactual", 2)], "frame_id string, raw_output string, mode string, ord int"))
    writers.annotated(frames, found, f"{root}/a")
    assert spark.read.json(f"{root}/a/manifest").count() == 3 and spark.read.json(f"{root}/a/counterfactual").count() == 1
    assert sorted(r.frame_id for r in spark.read.json(f"{root}/a/failed_ids").collect()) == ["b", "c"]
    assert {r.split for r in spark.read.json(f"{root}/a/by_split").collect()} == {"train", "val"}


def test_level_reports(spark, tmp_path):
    one = spark.createDataFrame([(f"m{k}", float(k)) for k in range(1500)], "metric string, value double")
    two = spark.createDataFrame([("gap", 0.1)], "metric string, value double")
    said = writers.level_reports({"grounding": one, "robustness": two}, str(tmp_path), evaluation.targets_met(two, [("gap", "<=", 0.2)]))
    assert said.count("\n") > 1500 and "met" in said
    assert spark.read.json(str(tmp_path / "final")).count() == 1501 and spark.read.text(str(tmp_path / "text")).count() > 1500


def test_model_folders(spark, tmp_path):
    (tmp_path / "a.safetensors").write_bytes(b"x" * 1000)
    (tmp_path / "b.bin").write_bytes(b"y" * 10)
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "quant_config.json").write_text('{"num_quantized_layers": 7}')
    r = readers.model_statistics(spark, str(tmp_path))
    assert r.first().asDict() == {"weight_files": 1, "size_bytes": 1000, "size_gb": 0.0, "compression_ratio": 4.0, "config_hash": hashlib.md5(b"{}").hexdigest(), "quantized_layers": 7}


def test_unreadable_parquet_and_order_of_files(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    assert readers.parquet(spark, str(tmp_path / "bad.parquet"), "a int", lenient=True).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        readers.parquet(spark, str(tmp_path / "bad.parquet"), "a int").count()
    folder = tmp_path / "truth"
    folder.mkdir()
    (folder / "1.jsonl").write_text("".join(json.dumps({"frame_id": "a", "source": "first", "metadata": {"location": "x" * 500}}) + "\n" for _ in range(50)))
    (folder / "2.jsonl").write_text(json.dumps({"frame_id": "a", "source": "last"}) + "\n")
    assert dataset.last_wins(readers.ground_truth(spark, str(folder)), "frame_id", "ord").first().source == "last"
