"""Queries of scoring and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardry.operators import analytics, scoring
from hazardry.plans.adapters import NESTED_RULE, SCORED_SQL, micros, nested_orders, scored_orders, table
from hazardry.plans.registry import query
from hazardry.streaming import bursts

_COLUMNS = "sample_token, scene_token, timestamp, scene_description, num_annotations, sig_proximity, sig_occlusion, sig_density, sig_weather, sig_vru, sig_cyclist, rarity_score"
_SIGNALS = [f"'{s}', {s}" for s in scoring.SIGNALS]


@query("rarity_scores", SCORED_SQL + f"SELECT {_COLUMNS} FROM scored")
def rarity_scores(spark, sf_dir):
    return scored_orders(spark, sf_dir)


@query("rare_frames", SCORED_SQL + f"SELECT {_COLUMNS} FROM scored WHERE rarity_score >= 3")
def rare_frames(spark, sf_dir):
    return scoring.rare(scored_orders(spark, sf_dir), 3)


@query("top_rare_frames", SCORED_SQL + f"SELECT {_COLUMNS} FROM scored ORDER BY rarity_score DESC, scene_token, timestamp, sample_token LIMIT 9")
def top_rare_frames(spark, sf_dir):
    return scoring.top(scored_orders(spark, sf_dir), 9)


_NESTED = """
WITH a AS (
  SELECT l_orderkey, l_returnflag = 'R' AS ped, l_returnflag <> 'R' AND l_linestatus = 'O' AS cyc, l_quantity AS d, l_discount FROM lineitem
),
f AS (
  SELECT l_orderkey, bool_or((ped OR cyc) AND d < 5) AS near, bool_or((ped OR cyc) AND d <= 5) AS near_inclusive, bool_or(l_discount >= 0.09) AS occ, bool_or(l_discount >= 0.06) AS occ2,
         bool_or(ped) AS ped, bool_or(cyc) AS cyc, count(*) AS n, count(*) FILTER (WHERE ped) AS n_ped, count(*) FILTER (WHERE cyc) AS n_cyc,
         count(*) FILTER (WHERE (ped OR cyc) AND d < 5) AS n_near, count(*) FILTER (WHERE l_discount >= 0.09) AS n_occ
  FROM a GROUP BY l_orderkey
),
s AS (
  SELECT o_orderkey::VARCHAR AS sample_token, o_orderpriority AS p, coalesce(n, 0) AS n, coalesce(near, false) AS near, coalesce(near_inclusive, false) AS near_inclusive, coalesce(occ, false) AS occ,
         coalesce(occ2, false) AS occ2, coalesce(ped, false) AS ped, coalesce(cyc, false) AS cyc, coalesce(n_ped, 0) AS n_ped, coalesce(n_cyc, 0) AS n_cyc, coalesce(n_near, 0) AS n_near, coalesce(n_occ, 0) AS n_occ
  FROM orders LEFT JOIN f ON l_orderkey = o_orderkey
)
"""


def _nested_sql(near: str, occ: str) -> str:
    parts = {
        "sig_proximity": near, "sig_occlusion": occ, "sig_density": "n >= 6", "sig_weather": "(p ILIKE '%urgent%' OR p ILIKE '%high%')",
        "sig_vru": "(ped AND (p ILIKE '%medium%' OR p ILIKE '%low%'))", "sig_cyclist": "cyc",
    }
    flags = ", ".join(f"({v})::INTEGER AS {k}" for k, v in parts.items())
    return f"{_NESTED} SELECT sample_token, {flags}, ({' + '.join(f'({v})::INTEGER' for v in parts.values())})::INTEGER AS rarity_score FROM s"


@query("rarity_scores_nested", _nested_sql("near", "occ"))
def rarity_scores_nested(spark, sf_dir):
    return scoring.score_frames(nested_orders(spark, sf_dir), NESTED_RULE).select("sample_token", *scoring.SIGNALS, "rarity_score")


@query("rarity_scores_inclusive", _nested_sql("near_inclusive", "occ2"))
def rarity_scores_inclusive(spark, sf_dir):
    from dataclasses import replace

    rule = replace(NESTED_RULE, inclusive=True, occlusion="overlap")
    return scoring.score_frames(nested_orders(spark, sf_dir), rule).select("sample_token", *scoring.SIGNALS, "rarity_score")


@query(
    "signal_details",
    _NESTED + """SELECT sample_token, n_near::INTEGER AS near_count, n_occ::INTEGER AS occluded_count, CASE WHEN p ILIKE '%urgent%' THEN 'urgent' WHEN p ILIKE '%high%' THEN 'high' ELSE '' END AS weather_keyword,
      n_ped::INTEGER AS pedestrians, n_cyc::INTEGER AS cyclists FROM s""",
)
def signal_details(spark, sf_dir):
    found = scoring.signal_details(nested_orders(spark, sf_dir), NESTED_RULE)
    return found.select("sample_token", F.size("near_objects").alias("near_count"), F.size("occluded_objects").alias("occluded_count"), "weather_keyword", "pedestrians", "cyclists")


_DISTRIBUTION = "SELECT rarity_score, count, round(sum(count) OVER (ORDER BY rarity_score)::DOUBLE / sum(count) OVER () * 100, 2) AS cumulative_pct FROM c"


@query("score_distribution", SCORED_SQL + f", c AS (SELECT rarity_score, count(*) AS count FROM scored GROUP BY 1) {_DISTRIBUTION}")
def score_distribution(spark, sf_dir):
    return analytics.score_distribution(scored_orders(spark, sf_dir))


@query(
    "score_distribution_dense",
    SCORED_SQL + f", c AS (SELECT r::INTEGER AS rarity_score, count(sample_token) AS count FROM range(7) t(r) LEFT JOIN scored ON rarity_score = r GROUP BY 1) {_DISTRIBUTION}",
)
def score_distribution_dense(spark, sf_dir):
    return analytics.score_distribution(scored_orders(spark, sf_dir), dense=True)


@query(
    "signal_cooccurrence",
    SCORED_SQL + " UNION ALL ".join(f"SELECT '{a}' AS signal_a, '{b}' AS signal_b, sum({a} * {b})::BIGINT AS count FROM scored" for a in scoring.SIGNALS for b in scoring.SIGNALS),
)
def signal_cooccurrence(spark, sf_dir):
    return analytics.cooccurrence(scored_orders(spark, sf_dir))


@query("signal_prevalence", SCORED_SQL + " UNION ALL ".join(f"SELECT '{s}' AS signal, sum({s})::BIGINT AS count, round(sum({s})::DOUBLE / count(*) * 100, 2) AS pct FROM scored" for s in scoring.SIGNALS))
def signal_prevalence(spark, sf_dir):
    return analytics.prevalence(scored_orders(spark, sf_dir))


@query(
    "scene_stats",
    SCORED_SQL + """SELECT scene_token, count(*) AS frame_count, sum((rarity_score >= 3)::INTEGER)::BIGINT AS rare_frame_count, round(avg(rarity_score), 3) AS mean_rarity_score,
      max(rarity_score) AS max_rarity_score, sum(rarity_score)::BIGINT AS total_rarity FROM scored GROUP BY scene_token""",
)
def scene_stats(spark, sf_dir):
    return analytics.scene_stats(scored_orders(spark, sf_dir))


@query("export_summary", SCORED_SQL + "SELECT count(*) AS total_frames, sum((rarity_score >= 3)::INTEGER)::BIGINT AS filtered_frames, round(sum((rarity_score >= 3)::INTEGER)::DOUBLE / greatest(count(*), 1) * 100, 1) AS filter_rate_pct FROM scored")
def export_summary(spark, sf_dir):
    return analytics.export_summary(scored_orders(spark, sf_dir))


@query("category_breakdown", "SELECT p_type AS category_name, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def category_breakdown(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))  # fold before the join
    met = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy(F.col("p_type").alias("category_name")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "category_name")


@query(
    "nested_category_breakdown",
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'human.pedestrian.adult' WHEN l_linestatus = 'O' THEN 'vehicle.bicycle' ELSE 'vehicle.car' END AS category_name, count(*) AS count FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
)
def nested_category_breakdown(spark, sf_dir):
    return analytics.category_breakdown(nested_orders(spark, sf_dir))


_GAP = 6 * 3_600_000_000
_BURSTS = f"""
WITH e AS (SELECT user_id AS scene_token, event_id AS sample_token, epoch_us(ts) AS timestamp FROM events WHERE event_type = 'error'),
g AS (SELECT *, lag(timestamp) OVER (PARTITION BY scene_token ORDER BY timestamp, sample_token) AS prev_timestamp FROM e),
b AS (SELECT *, timestamp - prev_timestamp AS time_gap FROM g),
bursts AS (
  SELECT *, (sum(CASE WHEN time_gap IS NULL OR time_gap > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY scene_token ORDER BY timestamp, sample_token ROWS UNBOUNDED PRECEDING))::BIGINT AS burst_id FROM b
)
"""


def _errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")  # before the window: it can't pass through one
    return rows.select(F.col("user_id").alias("scene_token"), F.col("event_id").alias("sample_token"), micros(F.col("ts")).alias("timestamp"))


@query("temporal_bursts", _BURSTS + "SELECT scene_token, sample_token, timestamp, prev_timestamp, time_gap, burst_id FROM bursts")
def temporal_bursts(spark, sf_dir):
    return analytics.temporal_bursts(_errors(spark, sf_dir), gap=_GAP)


@query(
    "burst_summary",
    _BURSTS + 'SELECT scene_token, burst_id, count(*) AS frames, min(timestamp) AS "start", max(timestamp) AS "end", max(timestamp) - min(timestamp) AS span FROM bursts GROUP BY 1, 2',
)
def burst_summary(spark, sf_dir):
    return analytics.burst_summary(analytics.temporal_bursts(_errors(spark, sf_dir), gap=_GAP))


@query(
    "session_bursts",
    _BURSTS + "SELECT scene_token, count(*) AS frames, min(timestamp) AS start_us, max(timestamp) AS end_us FROM bursts GROUP BY scene_token, burst_id",
)
def session_bursts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("scene_token"), "ts")
    found = bursts.session_bursts(rows, "scene_token", "ts", "6 hours")
    return found.select("scene_token", "frames", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"))
