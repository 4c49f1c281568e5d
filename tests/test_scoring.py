from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hazardry import schemas
from hazardry.operators import analytics, scoring

RULE = scoring.Rarity(dense=3, weather=("rain", "night", "fog"), intersection=("intersection", "crossing"))


def _a(kind, distance, level):
    return ("t", kind, 0.0, 0.0, 0.0, level, distance)


ADULT, CHILD, CAR, BIKE, MOTOR = "human.pedestrian.adult", "human.pedestrian.child", "vehicle.car", "vehicle.bicycle", "vehicle.motorcycle"


@pytest.fixture(scope="module")
def frames(spark):
    rows = [
        ("s001", "sc001", 1_000_000, "Night rain at an intersection", [_a(ADULT, 3.0, 1), _a(CHILD, 2.5, 2), _a(CAR, 10.0, 4), _a(CAR, 8.0, 4)]),
        ("s002", "sc001", 1_500_000, "Night rain at an intersection", [_a(BIKE, 6.0, 2), _a(MOTOR, 4.0, 1), _a(CAR, 15.0, 4)]),
        ("s003", "sc002", 2_000_000, "Clear day", [_a(CAR, 20.0, 4)]),
        ("s004", "sc002", 3_000_000, "Fog", [_a(ADULT, 8.0, 1), _a("vehicle.bus", 12.0, 2)]),
    ]
    return spark.createDataFrame([(t, s, ts, d, 0.0, 0.0, 0.0, "p", "c", len(a), a) for t, s, ts, d, a in rows], schemas.FRAME)


def _scores(df):
    return {r.sample_token: tuple(r[s] for s in scoring.SIGNALS) + (r.rarity_score,) for r in df.collect()}


def test_signals(frames):
    assert _scores(scoring.score_frames(frames, RULE)) == {
        "s001": (1, 1, 1, 1, 1, 0, 5), "s002": (1, 1, 1, 1, 0, 1, 5), "s003": (0, 0, 0, 0, 0, 0, 0), "s004": (0, 1, 0, 1, 0, 0, 2),
    }


def test_edges(spark):
    rows = [
        ("a", "s", 1, None, 0.0, 0.0, 0.0, "p", "c", 0, []), ("b", "s", 1, None, 0.0, 0.0, 0.0, "p", "c", None, None),
        ("c", "s", 1, "x", 0.0, 0.0, 0.0, "p", "c", 1, [_a(ADULT, 5.0, 2)]), ("d", "s", 1, "x", 0.0, 0.0, 0.0, "p", "c", 1, [_a(None, None, None), None]),
    ]
    df = spark.createDataFrame(rows, schemas.FRAME)
    assert {k: v[-1] for k, v in _scores(scoring.score_frames(df, RULE)).items()} == {"a": 0, "b": 0, "c": 0, "d": 0}
    wide = replace(RULE, inclusive=True, occlusion="overlap")
    assert _scores(scoring.score_frames(df, wide))["c"][:2] == (1, 1)


def test_rare_and_top(frames):
    scored = scoring.score_frames(frames, RULE)
    assert [r.sample_token for r in scoring.rare(scored, 3).collect()] == ["s001", "s002"]
    assert scoring.rare(scored, 0).count() == 4
    assert [r.sample_token for r in scoring.top(scored, 3).collect()] == ["s001", "s002", "s004"]
    with pytest.raises(ValueError):
        scoring.rare(frames)


def test_details(frames):
    found = {r.sample_token: r for r in scoring.signal_details(frames, RULE).collect()}
    assert len(found["s001"].near_objects) == 2 and found["s001"].weather_keyword == "rain" and found["s001"].pedestrians == 2
    assert found["s002"].cyclists == 2 and found["s003"].weather_keyword == ""


def test_distribution(frames):
    scored = scoring.score_frames(frames, RULE)
    assert [tuple(r) for r in analytics.score_distribution(scored).orderBy("rarity_score").collect()] == [(0, 1, 25.0), (2, 1, 50.0), (5, 2, 100.0)]
    assert [r["count"] for r in analytics.score_distribution(scored, dense=True).orderBy("rarity_score").collect()] == [1, 0, 1, 0, 0, 2, 0]


def test_cooccurrence_is_symmetric_with_totals_on_its_diagonal(frames):
    scored = scoring.score_frames(frames, RULE)
    pairs = {(r.signal_a, r.signal_b): r["count"] for r in analytics.cooccurrence(scored).collect()}
    assert len(pairs) == 36 and all(pairs[a, b] == pairs[b, a] for a, b in pairs)
    assert {r.signal: r["count"] for r in analytics.prevalence(scored).collect()} == {s: pairs[s, s] for s in scoring.SIGNALS}


def test_scene_stats(frames):
    rows = {r.scene_token: r for r in analytics.scene_stats(scoring.score_frames(frames, RULE)).collect()}
    assert rows["sc001"].mean_rarity_score == 5.0 and rows["sc002"].total_rarity == 2 and rows["sc002"].rare_frame_count == 0


def test_bursts(spark):
    rows = spark.createDataFrame([("a", 0, "1"), ("a", 2_000_000, "2"), ("a", 4_000_001, "3"), ("b", 1, "4")], "scene_token string, timestamp bigint, sample_token string")
    found = {r.sample_token: (r.time_gap, r.burst_id) for r in analytics.temporal_bursts(rows).collect()}
    assert found == {"1": (None, 1), "2": (2_000_000, 1), "3": (2_000_001, 2), "4": (None, 1)}


def test_one_pass_equals_join_form(spark, frames):
    """The six signals by joins, as a check of the single pass."""
    base = frames.select("sample_token")
    exploded = frames.select("sample_token", F.explode("annotations").alias("a"))
    near = exploded.filter((F.col("a.category_name").startswith(RULE.pedestrian) | F.col("a.category_name").contains("cycle")) & (F.col("a.distance_to_ego") < 5)).select("sample_token").distinct()
    joined = base.join(near.withColumn("x", F.lit(1)), "sample_token", "left").na.fill(0)
    assert {r.sample_token: r.x for r in joined.collect()} == {k: v[0] for k, v in _scores(scoring.score_frames(frames, RULE)).items()}


def test_plan_has_no_join(frames):
    plan = scoring.score_frames(frames, RULE)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
