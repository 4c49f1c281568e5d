"""The test tables as the engine's inputs: orders are frames, their lines annotations, customers scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardry.operators.scoring import Rarity, score_normalised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored by conditional aggregation over their lines."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_token"), F.col("o_custkey").cast("string").alias("scene_token"), micros(F.col("o_orderdate")).alias("timestamp"),
        F.lower("o_orderpriority").alias("scene_description"), F.col("o_orderstatus"), "o_orderkey",
    )
    line = F.col
    children = {
        "near": (line("l_returnflag") == "R") & (line("l_quantity") < 5),
        "occluded": line("l_discount") >= 0.09,
        "pedestrian": line("l_returnflag") == "R",
        "cyclist": (line("l_returnflag") == "N") & (line("l_linestatus") == "O") & (line("l_quantity") > 40),
    }
    text = F.col("scene_description")
    flags = {
        "sig_proximity": F.col("near") == 1,
        "sig_occlusion": F.col("occluded") == 1,
        "sig_density": F.col("n_children") >= 6,
        "sig_weather": text.contains("urgent") | text.contains("high"),
        "sig_vru": (F.col("pedestrian") == 1) & (F.col("o_orderstatus") == "F"),
        "sig_cyclist": F.col("cyclist") == 1,
    }
    scored = score_normalised(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", children, flags)
    return scored.select("sample_token", "scene_token", "timestamp", "scene_description", F.col("n_children").alias("num_annotations"), *flags, "rarity_score")


SCORED_SQL = """
WITH folded AS (
  SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 1 ELSE 0 END) AS near, max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS occluded,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pedestrian,
         max(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 40 THEN 1 ELSE 0 END) AS cyclist, count(*) AS n
  FROM lineitem GROUP BY l_orderkey
),
flags AS (
  SELECT o_orderkey::VARCHAR AS sample_token, o_custkey::VARCHAR AS scene_token, epoch_us(o_orderdate) AS timestamp, lower(o_orderpriority) AS scene_description,
         coalesce(n, 0)::INTEGER AS num_annotations, coalesce(near, 0)::INTEGER AS sig_proximity, coalesce(occluded, 0)::INTEGER AS sig_occlusion,
         (CASE WHEN coalesce(n, 0) >= 6 THEN 1 ELSE 0 END)::INTEGER AS sig_density,
         (CASE WHEN o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%' THEN 1 ELSE 0 END)::INTEGER AS sig_weather,
         (CASE WHEN pedestrian = 1 AND o_orderstatus = 'F' THEN 1 ELSE 0 END)::INTEGER AS sig_vru, coalesce(cyclist, 0)::INTEGER AS sig_cyclist
  FROM orders LEFT JOIN folded ON l_orderkey = o_orderkey
),
scored AS (SELECT *, (sig_proximity + sig_occlusion + sig_density + sig_weather + sig_vru + sig_cyclist)::INTEGER AS rarity_score FROM flags)
"""

#: The rule for nested orders: distance is the quantity, visibility comes from the discount.
NESTED_RULE = Rarity(dense=6, weather=("urgent", "high"), intersection=("medium", "low"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested frames."""
    category = F.when(F.col("l_returnflag") == "R", "human.pedestrian.adult").when(F.col("l_linestatus") == "O", "vehicle.bicycle").otherwise("vehicle.car")
    level = F.when(F.col("l_discount") >= 0.09, 1).when(F.col("l_discount") >= 0.06, 2).otherwise(4)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("token"), category.alias("category_name"), F.lit(0.0).alias("translation_x"), F.lit(0.0).alias("translation_y"),
                F.lit(0.0).alias("translation_z"), level.alias("visibility_level"), F.col("l_quantity").alias("distance_to_ego"),
            )
        ).alias("annotations")
    )
    met = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select(
        F.col("o_orderkey").cast("string").alias("sample_token"), F.col("o_custkey").cast("string").alias("scene_token"), micros(F.col("o_orderdate")).alias("timestamp"),
        F.col("o_orderpriority").alias("scene_description"), F.coalesce(F.size("annotations"), F.lit(0)).alias("_n"), "annotations",
    ).withColumn("num_annotations", F.greatest(F.col("_n"), F.lit(0))).drop("_n")


def embedded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as two boxes on the grid: vec_id, label, a, b."""
    e = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))

    def box(at: int) -> Column:
        x, y = e(at) * 400, e(at + 1) * 400
        return F.array(x, y, x + e(at + 2) * 400 + 50, y + e(at + 3) * 400 + 50)

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", box(0).alias("a"), box(4).alias("b"))


BOXES_SQL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: abs(v)) AS v FROM embeddings),
boxes AS (
  SELECT vec_id, label, v[1] * 400 AS ax1, v[2] * 400 AS ay1, v[1] * 400 + v[3] * 400 + 50 AS ax2, v[2] * 400 + v[4] * 400 + 50 AS ay2,
         v[5] * 400 AS bx1, v[6] * 400 AS by1, v[5] * 400 + v[7] * 400 + 50 AS bx2, v[6] * 400 + v[8] * 400 + 50 AS by2
  FROM e
)
"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as evaluated frames: quality is the truth, toxic the prediction."""
    return table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id")


def derived_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotation structs with all kinds of faults, by arithmetic on the id."""
    i = F.col("doc_id")
    num = lambda m: F.pmod(i, F.lit(m))
    hazard = F.struct(
        F.array((num(7) * 200).cast("double"), F.lit(100.0), (num(5) * 300).cast("double"), (num(3) * 100 + 50).cast("double")).alias("bbox_2d"),
        F.when(num(4) == 0, "Jaywalking ").when(num(4) == 1, "high_density").when(num(4) == 2, "no_hazard").otherwise("ufo").alias("label"),
        F.when(num(6) == 0, F.lit(None)).when(num(6) == 1, "extreme").otherwise("low").alias("severity"),
        F.when(num(3) == 0, "too short").otherwise(F.col("text")).alias("reasoning"),
        F.when(num(9) == 0, "").otherwise("brake").alias("action"),
    )
    ego = F.struct(F.when(num(2) == 0, "clear").alias("weather"), F.lit("day").alias("time_of_day"), F.lit("urban").alias("road_type"))
    annotation = F.struct(
        F.when(num(10) == 0, F.array().cast("array<struct<bbox_2d:array<double>,label:string,severity:string,reasoning:string,action:string>>")).otherwise(F.array(hazard)).alias("hazards"),
        F.when(num(8) != 0, F.lit("summary")).alias("scene_summary"),
        F.when(num(11) != 0, ego).alias("ego_context"),
    )
    mode = F.when(num(5) == 0, "counterfactual").otherwise("real")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("frame_id"), "doc_id", annotation.alias("annotation"), mode.alias("mode"))
