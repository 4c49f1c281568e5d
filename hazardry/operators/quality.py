"""How much two sets of model outputs differ, and running statistics of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = r'"bbox_2d"\s*:\s*\[([^\]]*)\]'
LABEL = r'"label"\s*:\s*"([^"]*)"'


def text_similarity(a: Column, b: Column) -> Column:
    """Share of places with the same character, of the longer text; 1 for two empty texts."""
    n = F.least(F.length(a), F.length(b))
    letters = lambda c: F.split(F.substring(c, F.lit(1), n), "")
    places = F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x == y), lambda same: same)
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(F.size(places) / most)


def boxes(text: Column) -> Column:
    """The coordinate lists of all boxes in a text, as numbers; a list that does not parse is null."""
    found = F.regexp_extract_all(text, F.lit(BOX), F.lit(1))
    numbers = F.transform(found, lambda s: F.transform(F.split(s, ","), lambda v: F.trim(v).try_cast("double")))
    return F.transform(numbers, lambda b: F.when(~F.exists(b, lambda v: v.isNull()), b))


def box_error(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute difference of the coordinates of boxes at the same place; pairs with a list that does not parse are skipped."""
    pairs = rows.select(F.explode(F.zip_with(boxes(F.col(a)), boxes(F.col(b)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p")).filter("p.x IS NOT NULL AND p.y IS NOT NULL")
    each = pairs.select(F.explode(F.zip_with("p.x", "p.y", lambda x, y: F.abs(x - y))).alias("d")).filter("d IS NOT NULL")
    return each.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 4).alias("bbox_mae"))


def label_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1))))


def labels_agree(a: Column, b: Column) -> Column:
    """Whether two texts name the same set of labels."""
    return label_set(a) == label_set(b)


def zipped(a: DataFrame, b: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Two lists of outputs joined by place; the shorter one decides. Columns: ord, text_a, text_b."""
    return a.select(ordinal, F.col("text").alias("text_a")).join(b.select(ordinal, F.col("text").alias("text_b")), ordinal)


def running(rows: DataFrame, value: str, by: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """Running mean and running minimum of a log."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"running_mean": F.round(F.avg(value).over(w), digits), "running_min": F.min(value).over(w)})


def early_stop(rows: DataFrame, value: str, by: list[str], order: str, patience: int = 3, threshold: float = 0.0) -> DataFrame:
    """Per log: the best value, and the step at which ``patience`` steps in a row had not improved it by more than the threshold (null if never).

    A fold over the log of one run, which is small.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast(rows.schema[order].dataType).alias("stop"))

    def fold(acc: Column, x: Column) -> Column:
        better = x["v"] < acc["best"] - F.lit(threshold)
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        going = acc["stop"].isNull()
        return F.struct(
            F.when(going & better, x["v"]).otherwise(acc["best"]).alias("best"),
            F.when(going, bad).otherwise(acc["bad"]).alias("bad"),
            F.when(going & (bad >= patience), x["o"]).otherwise(acc["stop"]).alias("stop"),
        )

    out = rows.groupBy(*by).agg(F.aggregate(steps, start, fold).alias("r"))
    return out.select(*by, F.col("r.best").alias("best"), F.col("r.stop").alias("stopped_at"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Records, share that parsed, mean time, one row."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg(F.col("parse_success").cast("int")), F.lit(0.0)), 4).alias("parse_rate"),
        F.round(F.coalesce(F.avg("generation_time_ms"), F.lit(0.0)), 1).alias("avg_ms"),
    )
