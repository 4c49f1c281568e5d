"""Queries of text and geometry expressions, datasets and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardry.functions import geometry, text
from hazardry.operators import annotation, dataset, scoring, sequences
from hazardry.operators.evaluation import infer_source, speed_bucket, stratum
from hazardry.plans.adapters import BOXES_SQL, derived_annotations, embedded_boxes, micros, table
from hazardry.plans.registry import query


def _contains(column: str, classes) -> str:
    tests = " ".join(f"WHEN {' OR '.join(f'contains({column}, {k!r})' for k in words)} THEN '{name}'" for name, words in classes if words)
    return f"CASE {tests} ELSE '{classes[-1][0]}' END"


@query(
    "keyword_classes",
    f"SELECT page_id, {_contains('lower(html)', text.WEATHER)} AS weather, {_contains('lower(html)', text.TIME_OF_DAY)} AS time_of_day, {_contains('lower(html)', text.ROAD_TYPE)} AS road_type FROM pages",
)
def keyword_classes(spark, sf_dir):
    c = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.classify(c, text.WEATHER).alias("weather"), text.classify(c, text.TIME_OF_DAY).alias("time_of_day"), text.classify(c, text.ROAD_TYPE).alias("road_type")
    )


@query(
    "first_keywords",
    "SELECT doc_id, CASE WHEN contains(lower(text), 'tion') THEN 'tion' WHEN contains(lower(text), 'heit') THEN 'Heit' WHEN contains(lower(text), 'que') THEN 'que' ELSE '' END AS keyword, (contains(lower(text), 'heit') OR contains(lower(text), 'que')) AS any_keyword FROM documents",
)
def first_keywords(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.first_keyword(c, ["tion", "Heit", "que"]).alias("keyword"), text.keyword_any(c, ["Heit", "que"]).alias("any_keyword"))


@query(
    "visibility_overlap",
    """WITH v AS (SELECT * FROM (VALUES (1, 0, 40), (2, 40, 60), (3, 60, 80), (4, 80, 100)) t(level, lo, hi)), l AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_linenumber, n AS lines, coalesce(lo, 80) <= 40 AND coalesce(hi, 100) >= 0 AS occluded FROM l LEFT JOIN v ON level = l_linenumber""",
)
def visibility_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("lines"))
    return rows.withColumn("occluded", scoring.visibility_overlaps(F.col("l_linenumber"), 0, 40))


@query("planar_distance", "SELECT vec_id, round(sqrt((v[1] - v[3]) * (v[1] - v[3]) + (v[2] - v[4]) * (v[2] - v[4])), 4) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def planar_distance(spark, sf_dir):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", geometry.planar_distance(*e).alias("distance"))


@query(
    "iou_pairs",
    BOXES_SQL + """, s AS (SELECT vec_id, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i,
      (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) AS t FROM boxes)
    SELECT vec_id, round(CASE WHEN t - i > 0 THEN i / (t - i) ELSE 0 END, 6) AS iou FROM s""",
)
def iou_pairs(spark, sf_dir):
    return embedded_boxes(spark, sf_dir).select("vec_id", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("bbox_normalize", BOXES_SQL + "SELECT vec_id, " + ", ".join(f"round_even(1000.0 * {c} / {1600 if c[1] == 'x' else 900}, 0)::INTEGER AS {c[1:]}" for c in ("ax1", "ay1", "ax2", "ay2")) + " FROM boxes")
def bbox_normalize(spark, sf_dir):
    box = geometry.to_grid(F.col("a"), F.lit(1600), F.lit(900))
    return embedded_boxes(spark, sf_dir).select("vec_id", *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(
    "letterbox_boxes",
    BOXES_SQL + """, g AS (SELECT *, least(672.0::DOUBLE / 1600, 448.0::DOUBLE / 900) AS s FROM boxes), p AS (SELECT *, floor((672 - trunc(1600 * s)) / 2) AS px, floor((448 - trunc(900 * s)) / 2) AS py FROM g)
    SELECT vec_id, round(ax1 * s + px, 4) AS x1, round(ay1 * s + py, 4) AS y1, round(ax2 * s + px, 4) AS x2, round(ay2 * s + py, 4) AS y2 FROM p""",
)
def letterbox_boxes(spark, sf_dir):
    box = geometry.letterbox(F.col("a"), F.lit(1600), F.lit(900), 672, 448)
    return embedded_boxes(spark, sf_dir).select("vec_id", *[F.round(F.get(box, F.lit(k)), 4).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("bbox_flip", BOXES_SQL + "SELECT vec_id, 1600 - ax2 AS x1, ay1 AS y1, 1600 - ax1 AS x2, ay2 AS y2 FROM boxes")
def bbox_flip(spark, sf_dir):
    box = geometry.flipped(F.col("a"), F.lit(1600.0))
    return embedded_boxes(spark, sf_dir).select("vec_id", *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(
    "bbox_fix",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    r AS (SELECT vec_id, """ + ", ".join(f"greatest(0, least(1000, round_even(v[{k + 1}] * 900 + 200, 0)::INTEGER)) AS c{k}" for k in range(4)) + """ FROM v),
    o AS (SELECT vec_id, least(c0, c2) AS x1, greatest(c0, c2) AS x2, least(c1, c3) AS y1, greatest(c1, c3) AS y2 FROM r)
    SELECT vec_id, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (CASE WHEN x1 = x2 THEN least(1000, x2 + 1) ELSE x2 END)::DOUBLE AS x2, (CASE WHEN y1 = y2 THEN least(1000, y2 + 1) ELSE y2 END)::DOUBLE AS y2 FROM o""",
)
def bbox_fix(spark, sf_dir):
    raw = F.array(*[F.get("embedding", F.lit(k)).cast("double") * 900 + 200 for k in range(4)])
    box = geometry.repaired(raw)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("projected_boxes")
def projected_boxes(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    corners = F.array(*[F.array(e(0) * 4 + dx, e(1) * 4 + dy, F.lit(8.0) + e(2) + dz) for dx in (-1.0, 1.0) for dy in (-1.0, 1.0) for dz in (-1.0, 1.0)])
    level, none = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    camera = F.array(F.array(F.lit(800.0), F.lit(0.0), F.lit(800.0)), F.array(F.lit(0.0), F.lit(800.0), F.lit(450.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    box = geometry.projected_box(corners, none, level, none, level, camera, F.lit(1600), F.lit(900))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.get(box, F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("zfill_keys", "SELECT c_custkey, CASE WHEN length(c_nationkey::VARCHAR) < 3 THEN lpad(c_nationkey::VARCHAR, 3, '0') ELSE c_nationkey::VARCHAR END || '/' || CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS key FROM customer")
def zfill_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", text.zfill(F.col("c_nationkey").cast("string"), 3), text.zfill(F.col("c_custkey").cast("string"), 3)).alias("key"))


@query("speed_buckets", "SELECT CASE WHEN l_quantity < 20 THEN '0-20' WHEN l_quantity < 40 THEN '20-40' ELSE '40+' END AS bucket, count(*) AS lines FROM lineitem GROUP BY 1")
def speed_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(speed_bucket(F.col("l_quantity")).alias("bucket")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "stratum_values",
    "SELECT doc_id, lower(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN upper(source) END, ''), 'unknown')) AS stratum, CASE WHEN source LIKE 'src1%' THEN 'dada2000' ELSE 'nuscenes' END AS origin FROM documents",
)
def stratum_values(spark, sf_dir):
    i = F.pmod("doc_id", F.lit(3))
    value = stratum(F.when(i == 0, F.col("lang")).otherwise(""), F.when(i == 1, F.upper("source")))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("stratum"), infer_source(F.regexp_replace("source", "^src1", "dada")).alias("origin"))


@query("image_uris", "SELECT page_id, CASE WHEN regexp_matches(url, '^(file|https?)://') THEN url ELSE 'file://' || url END AS uri, regexp_replace(url, '[^A-Za-z0-9_\\-]', '_', 'g') AS cache_name FROM pages")
def image_uris(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.with_scheme(F.col("url")).alias("uri"), text.safe_name(F.col("url")).alias("cache_name"))


@query("json_answers", "SELECT event_id, (props::JSON ->> 'k') AS k FROM events")
def json_answers(spark, sf_dir):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.json_object(wrapped), "$.k").alias("k"))


@query("judged_scores", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE (event_id % 5 + 1)::INTEGER END AS score FROM events")
def judged_scores(spark, sf_dir):
    n = (F.pmod("event_id", F.lit(5)) + 1).cast("string")
    whole, part = F.concat(F.lit('{"score": '), n, F.lit("}")), F.concat(F.lit('I say "score" : '), n, F.lit(" because"))
    raw = F.when(F.pmod("event_id", F.lit(3)) == 0, whole).when(F.pmod("event_id", F.lit(3)) == 1, part).otherwise("nothing")
    return table(spark, sf_dir, "events").select("event_id", text.judged_score(raw).alias("score"))


@query("label_masks", "SELECT conv_id, turn, length(text) AS n, CASE WHEN instr(text, ' t') > 0 THEN instr(text, ' t') + 1 ELSE length(text) END AS start FROM conversations")
def label_masks(spark, sf_dir):
    # a null text has null counts, an empty one no ids
    letters = F.when(F.length("text") == 0, F.array().cast("array<string>")).otherwise(F.split("text", ""))
    ids = F.transform(letters, lambda c: F.when(c == " ", 1).when(c == "t", 2).otherwise(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    masked = rows.withColumn("labels", annotation.masked_labels(F.col("ids"), annotation.label_start(F.col("ids"), [1, 2]), 4096))
    return masked.select("conv_id", "turn", F.size("labels").alias("n"), F.size(F.filter("labels", lambda v: v == -100)).alias("start"))


# --- datasets and sequences


def _split_sql(strata: str) -> str:
    return f"""WITH o AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY {strata} ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY {strata}) AS n FROM documents)
    SELECT doc_id, lang, source, CASE WHEN k <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE) + 0.5) THEN 'val' ELSE 'test' END AS split FROM o"""


def _split(spark, sf_dir):
    return dataset.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang"])


@query("stratified_split", _split_sql("lang"))
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(
    "split_statistics",
    f"""WITH s AS ({_split_sql('lang')}), g AS (SELECT split, source, lang, count(*) AS count, GROUPING(split) AS g1, GROUPING(source) AS g2, GROUPING(lang) AS g3 FROM s GROUP BY GROUPING SETS ((), (split), (source), (lang)))
    SELECT CASE WHEN g1 = 0 THEN 'split' WHEN g2 = 0 THEN 'source' WHEN g3 = 0 THEN 'lang' ELSE 'total' END AS dimension,
           CASE WHEN g1 = 0 THEN split WHEN g2 = 0 THEN source WHEN g3 = 0 THEN lang ELSE 'all' END AS value, count FROM g""",
)
def split_statistics(spark, sf_dir):
    return dataset.statistics(_split(spark, sf_dir), ("split", "source", "lang"))


@query(
    "sequential_split",
    """WITH o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k, count(*) OVER () AS n FROM supplier)
    SELECT s_suppkey, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o""",
)
def sequential_split(spark, sf_dir):
    return dataset.sequential_split(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])


@query(
    "hashed_split",
    "WITH h AS (SELECT o_orderkey, ('0x' || substring(md5('42:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM h",
)
def hashed_split(spark, sf_dir):
    return dataset.hashed_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "unified_union",
    f"""SELECT doc_id::VARCHAR AS frame_id, 'nuscenes' AS source, '' AS image_path, {_contains("coalesce(source, '')", text.WEATHER)} AS weather, {_contains("coalesce(source, '')", text.TIME_OF_DAY)} AS time_of_day, 'urban' AS road_type, 'vehicle' AS category, n_chars::INTEGER AS rarity_score FROM documents
    UNION ALL SELECT page_id::VARCHAR, 'dada2000', url, 'clear', 'day', 'urban', '001', 0 FROM pages""",
)
def unified_union(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_token"), F.col("source").alias("description"), F.col("n_chars").cast("int").alias("total_score"))
    frames = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("frame_id"), F.col("url").alias("image_path"))
    return dataset.unified(scored, frames).select("frame_id", "source", "image_path", "weather", "time_of_day", "road_type", "category", "rarity_score")


@query("last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(spark, sf_dir):
    return dataset.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("failed_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def failed_ids(spark, sf_dir):
    return annotation.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query(
    "available_frames",
    "SELECT page_id, true AS present FROM pages WHERE regexp_extract(url, '[^/]*$') IN (SELECT doc_id::VARCHAR FROM documents) UNION ALL SELECT page_id, false FROM pages WHERE regexp_extract(url, '[^/]*$') NOT IN (SELECT doc_id::VARCHAR FROM documents)",
)
def available_frames(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("image_path"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"))
    sides = [dataset.available(pages, files, present=p).select("page_id", F.lit(p).alias("present")) for p in (True, False)]
    return sides[0].unionByName(sides[1])


@query("training_view", "SELECT doc_id::VARCHAR AS frame_id, 'Find hazards.' AS prompt, '{}' AS annotation, lang AS weather FROM documents")
def training_view(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("frame_id"), "source", F.col("lang").alias("weather"), F.lit("day").alias("time_of_day"), F.lit("urban").alias("road_type"), F.lit("train").alias("split"),
        F.lit(None).cast("array<struct<label:string>>").alias("annotations"),
    )
    return dataset.training_view(rows, "Find hazards.").select("frame_id", "prompt", "annotation", F.col("metadata.weather").alias("weather"))


@query(
    "catalog_join",
    """SELECT r_name, n_name, c_mktsegment, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
)
def catalog_join(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))  # fold the fact table on its first key
    met = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("lines"), F.round(F.sum("q"), 2).alias("quantity"))


_KEYFRAMES = """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS frame_index, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, greatest(1, least(CASE WHEN user_id % 2 = 0 THEN user_id % 90 ELSE n END, n)) AS crit FROM e),
k AS (SELECT user_id, event_id, frame_index, CASE WHEN frame_index < crit THEN 'pre_accident' WHEN frame_index = crit THEN 'critical' ELSE 'mid_accident' END AS frame_type FROM c WHERE abs(frame_index - crit) <= 2)
"""


def _keyframes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.pmod("user_id", F.lit(2)) == 0, F.pmod("user_id", F.lit(90)).cast("int")).alias("accident"))
    return sequences.keyframes(rows, ["user_id"], ["event_id"], "accident").select("user_id", "event_id", "frame_index", "frame_type")


@query("keyframes", _KEYFRAMES + "SELECT * FROM k")
def keyframes(spark, sf_dir):
    return _keyframes(spark, sf_dir)


@query("keyframe_budget", _KEYFRAMES + "SELECT * FROM k ORDER BY user_id, frame_index LIMIT 200")
def keyframe_budget(spark, sf_dir):
    return sequences.budget(_keyframes(spark, sf_dir), 200, ["user_id", "frame_index"])


@query("keyframe_files", _KEYFRAMES + "SELECT event_id, printf('dada_cat%02d_seq%s_frame%04d_%s', (user_id % 60)::INTEGER, user_id::VARCHAR, frame_index, frame_type) AS file FROM k")
def keyframe_files(spark, sf_dir):
    rows = _keyframes(spark, sf_dir).withColumns({"category": F.pmod("user_id", F.lit(60)).cast("string"), "sequence": F.col("user_id").cast("string")})
    return rows.select("event_id", sequences.frame_file().alias("file"))


@query(
    "described_sequences",
    f"""SELECT p_partkey, {_contains("lower(p_name || ' ' || p_type)", text.WEATHER)} AS weather, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'dusk' END, {_contains("lower(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE '' END)", text.TIME_OF_DAY)}) AS time_of_day FROM part"""
    .replace("lower(p_name || ' ' || p_type)", "lower(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE '' END)"),
)
def described_sequences(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sheet = part.filter("p_partkey % 2 = 0").select(
        F.lit("1").alias("Category"), F.col("p_partkey").cast("string").alias("SEQ"), F.lit("7").alias("Accident Frame"), F.concat_ws(" ", "p_name", "p_type").alias("desc"), F.lit("dusk").alias("lighting")
    )
    rows = part.select("p_partkey", F.lit("001").alias("category"), text.zfill(F.col("p_partkey").cast("string"), 3).alias("sequence"))
    return sequences.described(rows, sequences.sheet(sheet)).select("p_partkey", "weather", "time_of_day")


@query("sequence_categories", "SELECT c_mktsegment AS category, count(*) AS count FROM customer GROUP BY 1")
def sequence_categories(spark, sf_dir):
    return sequences.category_distribution(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "category"))


@query("sequence_summary", "SELECT count(*) AS total_sequences, count(DISTINCT c_mktsegment) AS num_categories, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS annotated_sequences FROM customer")
def sequence_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.when(F.col("c_acctbal") > 0, 1).alias("accident_frame"))
    return sequences.summary(rows)


@query("top_categories", "SELECT p_type AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, category LIMIT 5")
def top_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category").limit(5)


# --- annotations and training records

_HAZARD = """
WITH a AS (
  SELECT doc_id, doc_id::VARCHAR AS frame_id, doc_id % 10 = 0 AS empty, doc_id % 8 <> 0 AS has_summary, doc_id % 11 <> 0 AS has_ego, doc_id % 2 = 0 AS has_weather,
         (doc_id % 7 * 200)::DOUBLE AS x1, (doc_id % 5 * 300)::DOUBLE AS x2, (doc_id % 3 * 100 + 50)::DOUBLE AS y2,
         CASE doc_id % 4 WHEN 0 THEN 'Jaywalking ' WHEN 1 THEN 'high_density' WHEN 2 THEN 'no_hazard' ELSE 'ufo' END AS label,
         CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'extreme' ELSE 'low' END AS severity,
         CASE WHEN doc_id % 3 = 0 THEN 'too short' ELSE text END AS reasoning, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'brake' END AS action,
         CASE WHEN doc_id % 5 = 0 THEN 'counterfactual' ELSE 'real' END AS mode
  FROM documents
),
"""


def _errors_sql(label: str, x1: str, y1: str, x2: str, y2: str, summary: str, ego: str, weather: str) -> str:
    show = lambda c: f"(CASE WHEN {c} = floor({c}) THEN floor({c})::BIGINT::VARCHAR ELSE {c}::VARCHAR END)"
    labels = ", ".join(f"'{x}'" for x in annotation.LABELS)
    low, high = f"greatest({x1}, {y1}, {x2}, {y2}) > 1000", f"CASE WHEN {x1} > 1000 THEN {x1} WHEN {y1} > 1000 THEN {y1} WHEN {x2} > 1000 THEN {x2} ELSE {y2} END"
    parts = [
        f"CASE WHEN NOT {summary} THEN 'Missing top-level key: ''scene_summary''' END", f"CASE WHEN NOT {ego} THEN 'Missing top-level key: ''ego_context''' END",
        "CASE WHEN empty THEN '''hazards'' list is empty' END",
        "CASE WHEN NOT empty AND severity IS NULL THEN 'hazards[0] missing key ''severity''' END",
        f"CASE WHEN NOT empty AND {low} THEN 'hazards[0].bbox_2d value ' || {show('(' + high + ')')} || ' out of [0, 1000]' END",
        f"CASE WHEN NOT empty AND {x1} >= {x2} THEN 'hazards[0].bbox_2d x1 (' || {show(x1)} || ') >= x2 (' || {show(x2)} || ')' END",
        f"CASE WHEN NOT empty AND {y1} >= {y2} THEN 'hazards[0].bbox_2d y1 (' || {show(y1)} || ') >= y2 (' || {show(y2)} || ')' END",
        f"CASE WHEN NOT empty AND {label} NOT IN ({labels}) THEN 'hazards[0].label ''' || {label} || ''' not in VALID_LABELS' END",
        "CASE WHEN NOT empty AND coalesce(severity, '') NOT IN ('critical', 'high', 'medium', 'low') THEN 'hazards[0].severity ''' || coalesce(severity, '') || ''' not in VALID_SEVERITIES' END",
        "CASE WHEN NOT empty AND length(coalesce(reasoning, '')) < 20 THEN 'hazards[0].reasoning too short (< 20 chars)' END",
        "CASE WHEN NOT empty AND action = '' THEN 'hazards[0].action is empty' END",
        f"CASE WHEN {ego} AND NOT {weather} THEN 'ego_context missing key: ''weather''' END",
        f"CASE WHEN NOT {summary} THEN '''scene_summary'' is empty or missing' END",
    ]
    return f"concat_ws('; ', {', '.join(parts)})"


_PLAIN = _errors_sql("label", "x1", "100.0::DOUBLE", "x2", "y2", "has_summary", "has_ego", "has_weather")
_FIXED_LABEL = "(CASE WHEN trim(lower(label)) IN (" + ", ".join(f"'{x}'" for x in annotation.LABELS) + ") THEN trim(lower(label)) ELSE label END)"


@query("annotation_errors", _HAZARD.rstrip().rstrip(",") + f" SELECT frame_id, {_PLAIN} AS errors FROM a")
def annotation_errors(spark, sf_dir):
    return derived_annotations(spark, sf_dir).select("frame_id", F.array_join(annotation.errors(F.col("annotation")), "; ").alias("errors"))


_MENDED = _HAZARD + f"""
b AS (SELECT *, {_FIXED_LABEL} AS fl, greatest(0, least(1000, x1)) AS c1, greatest(0, least(1000, x2)) AS c2, greatest(0, least(1000, y2)) AS d2 FROM a),
o AS (SELECT *, least(c1, c2) AS fx1, greatest(c1, c2) AS gx2, least(100.0::DOUBLE, d2) AS fy1, greatest(100.0::DOUBLE, d2) AS gy2 FROM b),
f AS (SELECT *, CASE WHEN fx1 = gx2 THEN least(1000, gx2 + 1) ELSE gx2 END AS fx2, CASE WHEN fy1 = gy2 THEN least(1000, gy2 + 1) ELSE gy2 END AS fy2 FROM o),
r AS (SELECT *, {_PLAIN} <> '' AS auto_fixed, {_errors_sql("fl", "fx1", "fy1", "fx2", "fy2", "true", "true", "true")} AS errors FROM f)
"""


@query("annotation_fixed", _MENDED + "SELECT frame_id, errors, auto_fixed FROM r")
def annotation_fixed(spark, sf_dir):
    rows = derived_annotations(spark, sf_dir)
    return rows.select("frame_id", F.array_join(annotation.errors(annotation.fixed(F.col("annotation"))), "; ").alias("errors"), (F.size(annotation.errors(F.col("annotation"))) > 0).alias("auto_fixed"))


def _results(spark, sf_dir):
    rows = derived_annotations(spark, sf_dir)
    first = F.size(annotation.errors(F.col("annotation"))) > 0
    return rows.select("frame_id", "mode", annotation.fixed(F.col("annotation")).alias("annotation"), annotation.errors(annotation.fixed(F.col("annotation"))).alias("validation_errors"), first.alias("auto_fixed"))


@query(
    "quality_report",
    _MENDED + """, v AS (SELECT * FROM r WHERE errors = '') , t AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM v) AS k)
    SELECT 'total_frames' AS metric, n::DOUBLE AS value FROM t UNION ALL SELECT 'success_count', k::DOUBLE FROM t UNION ALL SELECT 'success_rate', round(k::DOUBLE / n, 4) FROM t
    UNION ALL SELECT 'auto_fix_count', count(*)::DOUBLE FROM v WHERE auto_fixed UNION ALL SELECT 'auto_fix_rate', round((SELECT count(*) FROM v WHERE auto_fixed)::DOUBLE / n, 4) FROM t
    UNION ALL SELECT 'real_annotation_count', count(*)::DOUBLE FROM r WHERE mode <> 'counterfactual' UNION ALL SELECT 'counterfactual_count', count(*)::DOUBLE FROM r WHERE mode = 'counterfactual'
    UNION ALL SELECT 'avg_hazards_per_frame', round(coalesce(avg((NOT empty)::INTEGER), 0), 2) FROM v
    UNION ALL SELECT 'avg_reasoning_length_chars', round(coalesce(avg(length(reasoning)), 0), 1) FROM v WHERE NOT empty
    UNION ALL SELECT 'label:' || fl, count(*)::DOUBLE FROM v WHERE NOT empty GROUP BY 1 UNION ALL SELECT 'severity:' || severity, count(*)::DOUBLE FROM v WHERE NOT empty GROUP BY 1""",
)
def quality_report(spark, sf_dir):
    return annotation.quality_report(_results(spark, sf_dir))


@query(
    "counterfactual_selection",
    _MENDED + """, e AS (SELECT frame_id FROM r WHERE errors = '' AND fl NOT IN ('no_hazard', 'adverse_weather'))
    SELECT frame_id FROM e ORDER BY md5('42:' || frame_id), frame_id LIMIT (SELECT greatest(1, floor(count(*) * 0.3::DOUBLE))::BIGINT FROM e)""",
)
def counterfactual_selection(spark, sf_dir):
    return annotation.counterfactual_selection(_results(spark, sf_dir)).select("frame_id")


@query(
    "scenario_eligibility",
    """WITH s AS (SELECT * FROM (VALUES (0, ['en', 'fr']), (1, ['de']), (2, ['en', 'de', 'fr'])) t(scenario_id, x)), d AS (SELECT doc_id::VARCHAR AS frame_id, lang FROM documents),
    m AS (SELECT frame_id, scenario_id FROM d, s WHERE NOT list_contains(x, lang))
    SELECT * FROM m UNION ALL SELECT frame_id, scenario_id FROM d, s WHERE frame_id NOT IN (SELECT frame_id FROM m)""",
)
def scenario_eligibility(spark, sf_dir):
    bank = spark.createDataFrame([(0, ["en", "fr"]), (1, ["de"]), (2, ["en", "de", "fr"])], "scenario_id int, exclude_road_types array<string>")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("frame_id"), F.col("lang").alias("road_type"))
    return annotation.eligible_scenarios(rows, bank)


@query("template_annotations", "SELECT doc_id::VARCHAR AS frame_id, CASE WHEN doc_id % 3 = 0 THEN 'occluded_pedestrian' ELSE 'high_density' END AS label, 0 AS n_errors, lang AS weather FROM documents")
def template_annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("frame_id"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "dada2000").otherwise("nuscenes").alias("source"),
        F.col("lang").alias("weather"), F.lit("day").alias("time_of_day"), F.lit("urban").alias("road_type"),
    )
    found = annotation.results(annotation.template_answer(rows))
    return found.select("frame_id", F.get("annotation.hazards", F.lit(0))["label"].alias("label"), F.size("validation_errors").alias("n_errors"), F.col("annotation.ego_context.weather").alias("weather"))


@query(
    "annotation_diversity",
    _MENDED + """, s AS (SELECT lang FROM documents), l AS (SELECT 'label' AS dimension, fl AS value, count(*) AS count FROM r WHERE NOT empty GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 2)
    SELECT * FROM l UNION ALL SELECT 'severity', coalesce(severity, ''), count(*) FROM r WHERE NOT empty GROUP BY 2 UNION ALL SELECT 'source', coalesce(lang, 'unknown'), count(*) FROM s GROUP BY 2""",
)
def annotation_diversity(spark, sf_dir):
    rows = _results(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("frame_id"), F.col("lang").alias("source")), "frame_id")
    return annotation.diversity(rows, most=2)


@query(
    "image_path_map",
    """WITH f AS (SELECT page_id, '/data/' || CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'images/' || page_id || '.png' END AS a, '/cam/' || page_id || '.png' AS b FROM pages),
    p AS (SELECT CASE WHEN page_id % 2 = 0 THEN '/data/images/' ELSE '/cam/' END || page_id || '.png' AS path FROM pages)
    SELECT page_id, CASE WHEN a IN (FROM p) THEN a WHEN b IN (FROM p) THEN b END AS image FROM f""",
)
def image_path_map(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("page_id", F.lit(".png")).alias("_n"))
    frames = rows.select("page_id", F.when(F.pmod("page_id", F.lit(3)) != 0, F.concat(F.lit("images/"), "_n")).alias("exported_image_path"), F.concat(F.lit("/anywhere/"), "_n").alias("cam_front_path"))
    files = rows.select(F.concat(F.when(F.pmod("page_id", F.lit(2)) == 0, "/data/images/").otherwise("/cam/"), "_n").alias("path"))
    return dataset.image_paths(frames, files, "/data", "/cam", "page_id")


@query(
    "bbox_random_flip",
    BOXES_SQL + """SELECT vec_id, CASE WHEN ('0x' || substring(md5('42:' || vec_id), 1, 8))::BIGINT < 2147483648 THEN [round(5000 - ax2, 6), round(ay1, 6), round(5000 - ax1, 6), round(ay2, 6)]
    ELSE [round(ax1, 6), round(ay1, 6), round(ax2, 6), round(ay2, 6)] END AS box FROM boxes""",
)
def bbox_random_flip(spark, sf_dir):
    box = geometry.maybe_flipped(F.col("a"), F.lit(5000.0), F.col("vec_id"))
    return embedded_boxes(spark, sf_dir).select("vec_id", F.transform(box, lambda v: F.round(v, 6)).alias("box"))


@query("merged_annotations", "SELECT d.doc_id::VARCHAR AS frame_id, l.quality::VARCHAR AS annotation FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def merged_annotations(spark, sf_dir):
    frames = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("frame_id"))
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("frame_id"), F.col("quality").cast("string").alias("annotation"), F.lit(1).alias("ord"))
    older = found.select("frame_id", F.lit("old").alias("annotation"), F.lit(0).alias("ord"))
    return annotation.merged(frames, found.unionByName(older))


@query(
    "source_contexts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '- Rarity score: 3/6' || coalesce(chr(10) || '- Agent categories: ' || c, '') ELSE chr(10) || '- Accident category: ' || o_orderstatus || chr(10) || '- Frame type: critical' END AS context
    FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def source_contexts(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_set("l_returnflag"), lambda c: F.struct(c.alias("category_name"))).alias("annotations"))
    rows = table(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    even = F.pmod("o_orderkey", F.lit(2)) == 0
    frames = rows.select(
        "o_orderkey", F.when(even, "nuscenes").otherwise("dada2000").alias("source"), F.lit(3).alias("rarity_score"), "annotations", F.col("o_orderstatus").alias("category"),
        F.create_map(F.lit("frame_type"), F.lit("critical")).alias("source_metadata"),
    )
    return frames.select("o_orderkey", annotation.source_context().alias("context"))


def _messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return rows


@query(
    "sft_validity",
    "SELECT conv_id, count(*) >= 3 AND count(DISTINCT CASE WHEN role IN ('system', 'user', 'assistant') THEN role END) = 3 AS valid FROM conversations GROUP BY 1",
)
def sft_validity(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", annotation.sft_valid(F.col("messages")).alias("valid"))


@query("prompt_text", "SELECT conv_id, trim(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role <> 'assistant'), '')) AS prompt FROM conversations GROUP BY 1")
def prompt_text(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", annotation.prompt_text(F.col("messages")).alias("prompt"))


@query("sft_counts", f"WITH s AS ({_split_sql('lang')}) SELECT split, count(*) AS examples FROM s GROUP BY 1")
def sft_counts(spark, sf_dir):
    frames = _split(spark, sf_dir).select(F.col("doc_id").cast("string").alias("frame_id"), "source", "split", F.lit("a.png").alias("image_path"), F.struct(F.lit("x").alias("scene_summary")).alias("annotation"))
    examples = annotation.sft_examples(frames, "You see hazards.", "Find hazards.")
    return examples.filter(annotation.sft_valid(F.col("messages"), F.col("images"))).groupBy(dataset.known_split(F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("examples"))
