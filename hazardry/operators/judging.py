"""Judging of predictions by a model: prompts, calls, answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardry.functions.text import judged_score

#: What each dimension asks.
DIMENSIONS = {
    "correctness": "Is the hazard description factually correct?",
    "completeness": "Are all hazard aspects covered?",
    "action_relevance": "Is the ego-vehicle action advice appropriate?",
}


def judge_prompt(prediction: Column, truth: Column, dimension: Column, asked: Column) -> Column:
    """The user's turn for one prediction (JSON), its truth (JSON) and a dimension."""
    return F.concat(
        F.lit("Judge this dimension: "), dimension, F.lit("\nQuestion: "), asked, F.lit("\n\nGround truth:\n"), truth, F.lit("\n\nPrediction:\n"), prediction, F.lit("\n\nGive a score from 1 to 5 for "), dimension, F.lit(".")
    )


def prompts(pairs: DataFrame, dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """(frame_id, dimension, prompt) of pairs of hazards; ids, failure marks and ego contexts are left out of the prompt."""
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.lit(v).alias("asked")) for k, v in dimensions.items()])
    rows = pairs.select("frame_id", "pred", "true", F.inline(each))
    asked = lambda c: F.to_json(F.struct(F.col(c).alias("hazards")))
    return rows.select("frame_id", "dimension", judge_prompt(asked("pred"), asked("true"), F.col("dimension"), F.col("asked")).alias("prompt"))


def ask_judge(rows: DataFrame, client: Callable[[str], str], tasks: int = 5) -> DataFrame:
    """(frame_id, dimension, answer, score); a failed call scores 1. ``tasks`` bounds how many calls run at once."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for part in batches:
            out = []
            for frame, dimension, prompt in part[["frame_id", "dimension", "prompt"]].itertuples(index=False):
                try:
                    answer = client(prompt)
                except Exception as err:  # noqa: BLE001  any failure of a remote call is a failed judgement
                    answer = f"<error: {err}>"
                out.append((frame, dimension, answer))
            yield pd.DataFrame(out, columns=["frame_id", "dimension", "answer"])

    asked = rows.repartition(tasks).mapInPandas(run, "frame_id string, dimension string, answer string")
    return asked.withColumn("score", judged_score(F.col("answer")))


def calibration_texts(texts: DataFrame, n: int, fallback: tuple[str, ...] = ("Describe the hazards in this scene.", "What should the ego vehicle do?")) -> DataFrame:
    """The first n texts by ``ord``; if there are fewer, standard texts in turn fill up. n is small."""
    spare = texts.sparkSession.range(n).select((F.col("id") + F.lit(1 << 40)).alias("ord"), F.element_at(F.array(*[F.lit(t) for t in fallback]), (F.pmod("id", F.lit(len(fallback))) + 1).cast("int")).alias("text"))
    return texts.filter("text <> ''").select("ord", "text").unionByName(spare).orderBy("ord").limit(n)


def estimated_parameters(config: DataFrame) -> DataFrame:
    """Parameters of models from configuration rows: told, or estimated from the layers' sizes."""
    h, n, v = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("hidden_size", "num_hidden_layers", "vocab_size"))
    return config.withColumn("parameters", F.coalesce("num_parameters", h * h * 4 * n + v * h))


def patch_grid(height: Column, width: Column, patch: int = 28) -> Column:
    """[1, rows, columns] of whole patches."""
    return F.array(F.lit(1).cast("long"), F.floor(height / patch), F.floor(width / patch))
