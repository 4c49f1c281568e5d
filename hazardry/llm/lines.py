"""Line deduplication on levelled sorted runs.

The store is one table below a folder, with a partition for each run; all runs are bucketed and sorted by line hash into the same number of
buckets. A run holds how many documents of one batch have each
line. A new batch's lines are merge-anti-joined with the runs: lines that the runs already show in enough
documents are settled and aren't stored again; the rest is added as a run of level 0. When a level has
``fan_in`` runs, they are merged (counts added, bucket by bucket) into one run of the next level, so a line meets
each level once and a lookup reads few runs. Reading and merging runs takes no exchange: only a batch is dealt. A line is known by two 64-bit hashes.
The manifest, a file rewritten after each change, names the runs that count; so a store can be opened again, and what a broken write has left is ignored.

Counting combines before the shuffle, so a line that stands in every document costs a row per task. The
texts move once, to meet the numbers of the lines that they lose.

Defined results: a null or empty text is one empty line. Lines without characters after stripping are never
dropped. Rows count as documents, also when rows repeat. Rows with equal id and text (by 128 bits of hash) lose the same lines. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardry.llm.common import lower_ascii, materialise, qualified, read_text, remove, shared_path, strip_space, write_text

SECOND = 0x11E5
KEY = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The key of each line of a text: stripped, A-Z lower-cased."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: lower_ascii(strip_space(x)))


def hashed(key: Column) -> Column:
    """A line key as two independent hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SECOND), key).alias("h2"))


class RunStore:
    """Levelled runs of (h1, h2, n) below one folder. ``enough`` and the number of buckets are those of the folder's first opening."""

    def __init__(self, spark: SparkSession, path: str | None = None, enough: int = 10, fan_in: int = 3, buckets: int | None = None):
        self.spark, self.path, self.fan_in = spark, qualified(spark, path or shared_path(spark, "line-runs")), fan_in
        known = read_text(spark, f"{self.path}/manifest.json")
        self.state = json.loads(known) if known else {"enough": enough, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [], "written": 0}
        self.enough = self.state["enough"]
        self.name = f"hazardry_runs_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (h1 BIGINT, h2 BIGINT, n BIGINT, run BIGINT) USING parquet OPTIONS (path '{self.path}/runs') PARTITIONED BY (run) "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.state['buckets']} BUCKETS"
        )
        if known:
            spark.catalog.recoverPartitions(self.name)

    def close(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    @property
    def levels(self) -> list[list[int]]:
        """The runs of each level."""
        return self.state["levels"]

    def read(self, runs: list[int]) -> DataFrame:
        """The merged counts of some runs."""
        rows = self.spark.table(self.name).filter(F.col("run").isin(runs) if runs else F.lit(False))
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """The merged count of every line."""
        return self.read([run for level in self.levels for run in level])

    def frequent(self) -> DataFrame:
        """The lines that stand in enough documents."""
        return self.counts().filter(F.col("n") >= self.enough).select(*KEY)

    def _write(self, rows: DataFrame) -> int:
        self.state["written"] += 1
        run = self.state["written"]
        # one file a bucket
        dealt = rows.select("h1", "h2", "n", F.lit(run).cast("long").alias("run")).repartition(self.state["buckets"], *KEY)
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return run

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n), one row for each line; then merge the levels that are full."""
        fresh = batch.join(self.frequent(), KEY, "left_anti") if any(self.levels) else batch
        levels, run, level, old = [list(x) for x in self.levels], self._write(fresh), 0, []
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fan_in:
                break
            old += levels[level]
            run, levels[level], level = self._write(self.read(levels[level])), [], level + 1
        self.state["levels"] = levels
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
        for number in old:
            remove(self.spark, f"{self.path}/runs/run={number}")
        self.spark.catalog.refreshTable(self.name)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row id and text, with a key that rows share only if they agree in both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("_hz_id"), text.alias("_hz_t")).withColumn("_hz_row", F.struct(F.xxhash64("_hz_id", "_hz_t").alias("a"), F.xxhash64(F.lit(SECOND), "_hz_id", "_hz_t").alias("b")))


def batch_counts(df: DataFrame, text_col: str = "text", batches: int = 4, min_chars: int = 1) -> DataFrame:
    """(batch, h1, h2, n): in how many rows of each batch a line stands. Rows fall into batches by their text's hash."""
    distinct = F.array_distinct(F.filter(line_keys(F.col(text_col)), lambda k: F.length(k) >= min_chars))
    batch = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(batches)).cast("int")
    rows = df.select(batch.alias("batch"), F.explode(F.transform(distinct, hashed)).alias("k"))
    return rows.groupBy("batch", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", enough: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 3
) -> DataFrame:
    """Drop every line whose key stands in enough documents: id, n_lines, n_dropped, kept_text."""
    counted = materialise(batch_counts(df, text_col, batches, min_chars), "line-batches")
    store = RunStore(df.sparkSession, enough=enough, fan_in=fan_in)
    for number in range(batches):
        store.add(counted.filter(F.col("batch") == number).select(*KEY, "n"))
    frequent = materialise(store.frequent(), "frequent-lines")
    store.close()

    rows = _keyed(df, id_col, text_col)
    placed = rows.select("_hz_row", F.posexplode(F.transform(line_keys(F.col("_hz_t")), lambda k: F.when(F.length(k) >= min_chars, hashed(k)))))
    placed = placed.filter("col IS NOT NULL").select("_hz_row", "pos", "col.h1", "col.h2")
    hits = placed.join(frequent, KEY, "left_semi")
    lost = hits.groupBy("_hz_row").agg(F.collect_set("pos").alias("_hz_lost"))
    lines = F.split("_hz_t", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_hz_lost"))  # linear, by a hash set
    kept = F.when(F.col("_hz_lost").isNull(), lines).otherwise(F.transform(places, lambda i: F.get(lines, i)))
    return rows.join(lost, "_hz_row", "left").select(
        F.col("_hz_id").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("_hz_lost").isNull(), F.lit(0)).otherwise(F.size("_hz_lost")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
