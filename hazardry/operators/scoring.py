"""Rarity scoring of frames: six binary signals and their sum, in one pass and without a join.

Nested frames are tested by higher-order functions within the row. Normalised frames (children in a table of their
own) are scored by conditional aggregation: the children are combined to one row of flags for each frame, and that meets the
frames once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardry.functions.text import first_keyword, keyword_any

SIGNALS = ("sig_proximity", "sig_occlusion", "sig_density", "sig_weather", "sig_vru", "sig_cyclist")
#: Share of an object that is visible, in percent, by level.
VISIBILITY = {1: (0, 40), 2: (40, 60), 3: (60, 80), 4: (80, 100)}


@dataclass(frozen=True)
class Rarity:
    """Thresholds and keywords of the signals."""

    near_m: float = 5.0
    inclusive: bool = False
    occlusion: str = "level"  # or "overlap": the level's range meets occluded
    occluded: tuple[int, int] = (0, 40)
    dense: int = 15
    weather: tuple[str, ...] = ("rain", "night", "fog", "storm")
    intersection: tuple[str, ...] = ("intersection", "crossing", "junction", "traffic light", "turn")
    min_score: int = 3
    pedestrian: str = field(default="human.pedestrian")
    cycle: str = field(default="cycle")


def visibility_overlaps(level: Column, low: int, high: int) -> Column:
    """Whether a visibility level's range meets [low, high]; unknown levels count as the highest."""
    hits = [k for k, (a, b) in VISIBILITY.items() if a <= high and b >= low]
    return F.coalesce(F.when(level.isin(*VISIBILITY), level), F.lit(4)).isin(*hits)


def _any(annotations: Column, test) -> Column:
    return F.coalesce(F.exists(annotations, lambda a: F.coalesce(test(a), F.lit(False))), F.lit(False))


def predicates(rule: Rarity):
    """(pedestrian, cyclist, near, occluded) tests of one annotation."""
    pedestrian = lambda a: a["category_name"].startswith(rule.pedestrian)
    cyclist = lambda a: a["category_name"].contains(rule.cycle)
    reach = (lambda d: d <= rule.near_m) if rule.inclusive else (lambda d: d < rule.near_m)
    near = lambda a: (pedestrian(a) | cyclist(a)) & reach(a["distance_to_ego"])
    if rule.occlusion == "overlap":
        occluded = lambda a: visibility_overlaps(a["visibility_level"], *rule.occluded)
    else:
        occluded = lambda a: F.coalesce(a["visibility_level"], F.lit(4)) == 1
    return pedestrian, cyclist, near, occluded


def signal_columns(rule: Rarity) -> dict[str, Column]:
    """Boolean columns of the six signals of a nested frame."""
    rows, text = F.col("annotations"), F.col("scene_description")
    pedestrian, cyclist, near, occluded = predicates(rule)
    return {
        "sig_proximity": _any(rows, near),
        "sig_occlusion": _any(rows, occluded),
        "sig_density": F.coalesce(F.col("num_annotations") >= rule.dense, F.lit(False)),
        "sig_weather": keyword_any(text, rule.weather),
        "sig_vru": _any(rows, pedestrian) & keyword_any(text, rule.intersection),
        "sig_cyclist": _any(rows, cyclist),
    }


def with_score(df: DataFrame, names=SIGNALS) -> DataFrame:
    """The sum of integer flags as rarity_score."""
    return df.withColumn("rarity_score", reduce(add, [F.col(n) for n in names]).cast("int"))


def score_frames(frames: DataFrame, rule: Rarity = Rarity()) -> DataFrame:
    """Nested frames with the six flags and rarity_score."""
    flags = {name: test.cast("int") for name, test in signal_columns(rule).items()}
    return with_score(frames.withColumns(flags))


def signal_details(frames: DataFrame, rule: Rarity = Rarity()) -> DataFrame:
    """For each frame: what made its signals fire (near and occluded objects, keywords, counts)."""
    pedestrian, cyclist, near, occluded = predicates(rule)
    some = lambda test: F.filter(F.coalesce("annotations", F.array()), lambda a: F.coalesce(test(a), F.lit(False)))
    brief = lambda a: F.struct(a["token"].alias("token"), a["category_name"].alias("category"), F.round(a["distance_to_ego"], 3).alias("distance_m"))
    return score_frames(frames, rule).select(
        "sample_token",
        "rarity_score",
        F.transform(some(near), brief).alias("near_objects"),
        F.transform(some(occluded), lambda a: F.struct(a["token"].alias("token"), a["category_name"].alias("category"), a["visibility_level"].alias("level"))).alias("occluded_objects"),
        first_keyword(F.col("scene_description"), rule.weather).alias("weather_keyword"),
        F.size(some(pedestrian)).alias("pedestrians"),
        F.size(some(cyclist)).alias("cyclists"),
    )


def score_normalised(frames: DataFrame, children: DataFrame, frame_key: str, child_key: str, child_flags: Mapping[str, Column], flags: Mapping[str, Column]) -> DataFrame:
    """Flags of frames whose annotations are rows of another table.

    child_flags: tests of a child row, true for a frame if true for any of its children; a column ``n_children`` counts them. flags: the
    signals, in terms of the frame's columns, the child flags and n_children.
    """
    folded = children.groupBy(F.col(child_key).alias("_hz_key")).agg(
        *[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in child_flags.items()], F.count(F.lit(1)).cast("int").alias("n_children")
    )
    met = frames.join(folded, F.col(frame_key) == F.col("_hz_key"), "left").drop("_hz_key").na.fill(0, [*child_flags, "n_children"])
    found = met.withColumns({name: F.coalesce(test, F.lit(False)).cast("int") for name, test in flags.items()})
    return with_score(found, list(flags))


def rare(scored: DataFrame, min_score: int = 3, order: tuple[str, ...] = ("scene_token", "timestamp", "sample_token")) -> DataFrame:
    """Frames of at least a score, best first, ties by scene, time and token."""
    if "rarity_score" not in scored.columns:
        raise ValueError("score the frames first")
    return scored.filter(F.col("rarity_score") >= min_score).orderBy(F.desc("rarity_score"), *order)


def top(scored: DataFrame, n: int, order: tuple[str, ...] = ("scene_token", "timestamp", "sample_token")) -> DataFrame:
    """The n best frames."""
    return scored.orderBy(F.desc("rarity_score"), *order).limit(n)
