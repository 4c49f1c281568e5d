"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where its content says so: at the first ``e`` before a space or line end
after 512 characters, at 4096 at the latest. Equal stretches of different texts therefore fall into equal
chunks. A chunk gets a short identifier (64 bits); the dictionary verifies, over the whole corpus, that each identifier stands for one
chunk only, by the SHA-256 of the chunk's bytes. If one doesn't, all are identified anew, by that SHA-256 itself. A text's recipe is the ordered list
of its verified identifiers: texts are equal where their recipes are, and nothing else decides. What is shuffled is a few
bytes for each chunk; no text ever leaves the task that read it. (The SHA-256 of a text is a column of the result only.)

A hot group of copies is safe: groups are combined before the shuffle, written, and joined back by a
join that adaptive execution can split on the copies' side.

Defined results: null counts as the empty text; all empty texts are one group. Rows that agree in both
text and id are one document told twice: all get the same verdict, and ``keep_documents`` leaves one of them. A null id never
wins against another id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import lower_ascii, materialise, without_repeats

CHUNK = r"(?s).{512,4096}?(?:e[ \n]|\z)|.{1,4096}"


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For each row: id, text_sha256, and the chunks' identifiers and digests as ordered lists ``ids`` and ``digests``."""
    cut = df.select(F.col(id_col).alias("_hz_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_hz_t")).select(
        "_hz_id", F.sha2("_hz_t", 256).alias("text_sha256"), chunks(F.col("_hz_t")).alias("_hz_c")
    )
    digest = lambda c: F.unhex(F.sha2(c, 256))
    return cut.select("_hz_id", "text_sha256", F.transform("_hz_c", lambda c: identify(c)).alias("ids"), F.transform("_hz_c", lambda c: digest(c)).alias("digests"))


def dictionary(rows: DataFrame) -> DataFrame:
    """One row for each chunk identifier: how often it is used, and whether it stands for one chunk only."""
    pairs = rows.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).groupBy(F.col("c.ids").alias("chunk_id"), F.col("c.digests").alias("digest"))
    found = pairs.agg(F.count(F.lit(1)).alias("uses"))
    return found.groupBy("chunk_id").agg(F.sum("uses").alias("uses"), (F.count(F.lit(1)) == 1).alias("verified"))


def verified_recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(_hz_id, text_sha256, recipe): the recipe is the ordered list of verified identifiers."""
    rows = materialise(recipes(df, id_col, text_col, identify), "recipes")
    contested = not dictionary(rows).filter(~F.col("verified")).limit(1).isEmpty()
    return rows.select("_hz_id", "text_sha256", F.col("digests" if contested else "ids").alias("recipe"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256. ``identify`` makes the short identifier of a chunk."""
    rows = verified_recipes(df, id_col, text_col, identify)
    groups = rows.groupBy("recipe").agg(F.max("_hz_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.filter("group_size > 1"), "copies")
    return rows.join(groups, "recipe", "left").select(
        F.col("_hz_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_hz_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("_hz_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns that came in.

    Dropped ids are joined away, told apart by their texts' digests; they are few beside the texts, which move once.
    """
    verdicts = materialise(exact_groups(df, id_col, text_col), "exact-verdicts")
    dropped = verdicts.filter(~F.col("kept")).select(F.col(id_col).alias("_hz_drop_id"), F.col("text_sha256").alias("_hz_drop_text"))
    text_key = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    names = df.columns
    whole = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_hz_row"), F.col(id_col).alias("_hz_id"), text_key.alias("_hz_key"))
    match = F.col("_hz_id").eqNullSafe(F.col("_hz_drop_id")) & (F.col("_hz_key") == F.col("_hz_drop_text"))
    kept = whole.join(dropped, match, "left_anti")
    # a row told twice: its id and text stand twice among the kept
    twice = verdicts.filter("kept").groupBy(id_col, "text_sha256").count().filter("count > 1")
    if twice.limit(1).isEmpty():
        return kept.select("_hz_row.*")
    marked = kept.withColumn("_hz_id_text", F.coalesce(F.col("_hz_id").cast("string"), F.lit("null")))
    return without_repeats(marked, ["_hz_id_text", "_hz_key"], F.col("_hz_row")[text_col]).select("_hz_row.*")
