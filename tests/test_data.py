import json

import pytest
from pyspark.sql import functions as F

from hazardry import schemas
from hazardry.operators import dataset, sequences
from hazardry.sources import readers, writers
from hazardry.streaming import bursts


def test_json_sources(spark, tmp_path):
    good = {"frame_id": "a", "raw_output": 'x {"hazards": [{"bbox_2d": [1, 2, 3, 4], "label": "jaywalking"}]}', "parse_success": False}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({"frame_id": "b", "raw_output": "none", "parse_success": False}) + "\n")
    rows = {r.frame_id: r for r in readers.predictions(spark, str(tmp_path / "p.jsonl")).collect()}
    assert not rows["a"].parse_failure and len(rows["a"].hazards) == 1 and rows["b"].parse_failure
    (tmp_path / "bad.jsonl").write_text('{"frame_id": "a"}\nnot json\n')
    assert readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "frame_id string").count() == 1
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "frame_id string").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|MALFORMED"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "frame_id string", strict=True).collect()


def test_ground_truth_formats(spark, tmp_path):
    hazard = {"bbox_2d": [1, 2, 3, 4], "label": "jaywalking", "severity": "low"}
    spoken = {"frame_id": "a", "messages": [{"role": "assistant", "content": "?"}, {"role": "assistant", "content": json.dumps({"hazards": [hazard]})}]}
    direct = {"frame_id": "b", "hazards": [hazard, hazard], "ego_context": {"weather": "rain"}}
    (tmp_path / "t.json").write_text(json.dumps([spoken, direct]))
    rows = {r.frame_id: r for r in readers.ground_truth(spark, str(tmp_path / "t.json")).collect()}
    assert len(rows["a"].hazards) == 1 and len(rows["b"].hazards) == 2 and rows["b"].weather == "rain"


def test_catalog(spark):
    t = {
        "scene": spark.createDataFrame([("sc", "rain")], "token string, description string"),
        "sample": spark.createDataFrame([("s2", "sc", 2), ("s1", "sc", 1)], "token string, scene_token string, timestamp bigint"),
        "sample_data": spark.createDataFrame([("d1", "s1", "e", "a.jpg"), ("d2", "s2", "e", "b.jpg")], "token string, sample_token string, ego_pose_token string, filename string"),
        "ego_pose": spark.createDataFrame([("e", [0.0, 0.0, 0.0])], "token string, translation array<double>"),
        "sample_annotation": spark.createDataFrame([("x", "s1", "vehicle.car", [3.0, 4.0, 9.0], "v1"), ("y", "s1", "vehicle.car", [0.0, 1.0, 0.0], "gone")], "token string, sample_token string, category_name string, translation array<double>, visibility_token string"),
        "visibility": spark.createDataFrame([("v1", "1")], "token string, level string"),
    }
    rows = readers.catalog_frames(t).collect()
    assert [r.sample_token for r in rows] == ["s1", "s2"] and rows[0].num_annotations == 2 and rows[1].annotations == []
    assert {a.token: (a.distance_to_ego, a.visibility_level) for a in rows[0].annotations} == {"x": (5.0, 1), "y": (1.0, 4)}


def test_tree_and_keyframes(spark, tmp_path):
    for sequence, n in (("001/001", 5), ("001/002", 3)):
        folder = tmp_path / "tree" / sequence / "images"
        folder.mkdir(parents=True)
        for k in range(n):
            (folder / f"{k + 1:04d}.png").write_bytes(b"x")
    frames = readers.frame_tree(spark, str(tmp_path / "tree"))
    keys = sequences.keyframes(frames, ["category", "sequence"], ["name"])
    found = {(r.sequence, r.frame_index): r.frame_type for r in keys.collect()}
    assert found == {("001", 3): "pre_accident", ("001", 4): "pre_accident", ("001", 5): "critical", ("002", 1): "pre_accident", ("002", 2): "pre_accident", ("002", 3): "critical"}
    told = sequences.keyframes(frames.withColumn("acc", F.lit(2)), ["category", "sequence"], ["name"], "acc").filter("sequence = '001'")
    assert [r.frame_type for r in told.orderBy("frame_index").collect()] == ["pre_accident", "critical", "mid_accident", "mid_accident"]
    assert keys.select(sequences.frame_file().alias("f")).orderBy("f").first().f == "dada_cat01_seq001_frame0003_pre_accident"


def test_splits(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("frame_id"), F.when(F.col("id") < 30, "a").otherwise("b").alias("category"))
    split = dataset.stratified_split(rows, "frame_id", ["category"])
    counts = {(r.category, r.split): r["count"] for r in split.groupBy("category", "split").count().collect()}
    assert counts == {("a", "train"): 24, ("a", "val"): 3, ("a", "test"): 3, ("b", "train"): 56, ("b", "val"): 7, ("b", "test"): 7}
    assert writers.splits(split, str(tmp_path / "u")).count() == 3 and readers.split_of(spark, str(tmp_path / "u"), "val").count() == 10
    total = {(r.dimension, r.value): r["count"] for r in dataset.statistics(split, ("split", "category")).collect()}
    assert total["total", "all"] == 100 and total["split", "train"] == 80 and total["category", "a"] == 30


def test_unified(spark):
    scored = spark.createDataFrame([("s", "c", "rain", 4, [("t", "vehicle.car"), ("u", "human.x")])], "sample_token string, scene_token string, scene_description string, rarity_score int, annotations array<struct<token: string, category_name: string>>")
    frames = spark.createDataFrame([("d", "007")], "frame_id string, category string")
    rows = {r.frame_id: r for r in dataset.unified(scored, frames).collect()}
    assert rows["s"].category == "human.x" and rows["s"].weather == "rain" and rows["s"].source_metadata["camera"] == "CAM_FRONT"
    assert rows["d"].category == "007" and rows["d"].source_metadata["frame_type"] == "critical" and rows["d"].rarity_score == 0


def test_last_wins_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in dataset.last_wins(rows, "k", "o").collect()} == {"a": "y", "b": "z"}
    cache = writers.ResultCache(spark, str(tmp_path / "cache"))
    wanted = spark.createDataFrame([("a", "real"), ("b", "real")], "frame_id string, mode string")
    assert cache.misses(wanted).count() == 2
    cache.put(wanted.filter("frame_id = 'a'").withColumn("raw_output", F.lit("{}")))
    assert [r.frame_id for r in cache.misses(wanted).collect()] == ["b"]


def test_sheet(spark):
    raw = spark.createDataFrame([("1", "2", "12.0", "dark lot"), ("1", "3", "x", None)], "Category string, Seq string, `Accident Frame` string, desc string")
    found = {r.key: r for r in sequences.sheet(raw).collect()}
    assert found["001/002"].accident_frame == 12 and found["001/003"].accident_frame is None
    rows = spark.createDataFrame([("001", "002"), ("009", "009")], "category string, sequence string")
    out = {r.sequence: r for r in sequences.described(rows, sequences.sheet(raw)).collect()}
    assert (out["002"].weather, out["002"].road_type, out["009"].weather) == ("night", "parking", "clear")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:02"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:00"), ("z", "2024-01-02 00:00:00")], "scene string, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.scene, r.frames) for r in bursts.session_bursts(rows, "scene", "t").filter("scene <> 'z'").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = bursts.session_bursts(stream, "scene", "t").writeStream.format("memory").queryName("bursts_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    job.processAllAvailable()
    job.stop()
    assert {(r.scene, r.frames) for r in spark.sql("SELECT * FROM bursts_test").collect()} == batch == {("a", 2), ("a", 1), ("b", 1)}


def test_reports(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 1.0), ("b", None)], "metric string, value double")
    writers.report(metrics, str(tmp_path / "r"))
    assert readers.result_file(spark, str(tmp_path / "none"), "a int").count() == 0
    assert "a" in writers.text_report(metrics, "T") and schemas.FRAME


def test_empty_inputs(spark):
    none = readers.empty(spark, schemas.FRAME)
    from hazardry.operators import analytics, scoring

    scored = scoring.score_frames(none)
    assert scored.count() == 0 and analytics.cooccurrence(scored).count() == 36 and analytics.export_summary(scored).first().filter_rate_pct is not None
