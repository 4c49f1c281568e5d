"""Pieces that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a character class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local sessions an own folder where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hazardry-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the URI that Spark takes it for, with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", uri)


_SCRATCH: list[list[str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; within scratch() it goes when that ends."""
    path = f"{shared_dir(spark)}/hazardry/{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what operators have written to the shared folder within. Results are lazy: write or collect them inside."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            remove(spark, path)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system that Spark knows; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in one step for those who read it: written beside, then renamed."""
    jvm = spark._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = store.create(beside, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    store.delete(where, False)
    if not store.rename(beside, where):
        raise OSError(f"can't write {path}")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def without_repeats(df: DataFrame, key: list[str], smallest: Column) -> DataFrame:
    """One row, that with the smallest value, of each group of rows with equal keys without nulls; all other rows as they are.

    Only rows of repeated keys move, and they are combined before they do.
    """
    repeated = df.select(*key).dropna().groupBy(*key).count().filter("count > 1").select(*key)
    repeated = materialise(repeated, "repeated-keys")
    if repeated.limit(1).isEmpty():
        return df
    names = df.columns
    whole = F.struct(*[F.col(f"`{n}`") for n in names])
    firsts = df.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(whole, smallest).alias("_hz_whole"))
    return df.join(repeated, key, "left_anti").select(*names).unionByName(firsts.select("_hz_whole.*").select(*names))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def strip_space(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """The maximal runs of characters that aren't white space."""
    bare = strip_space(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+", -1))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts, with the place of the first, of a bounded number of characters (a longer text is a run of its own)."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, texts[at:]


def trim() -> None:
    """Give freed memory of this process back, where the C library can: reused Python workers keep it while the next stage runs beside them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


class TwoGenerations:
    """A bounded cache of what many keys map to.

    When the young generation is full it becomes the old one, and keys found there move back: frequent keys stay,
    rare ones go.
    """

    def __init__(self, make: Callable[[list], list], most: int = 400_000):
        self.make, self.most = make, most
        self.young: dict = {}
        self.old: dict = {}

    def of(self, keys: set) -> dict:
        """A mapping that has all the keys."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for key in keys.difference(young):  # of a dictionary, not of its view, which would walk the whole cache
            if key in old:
                young[key] = old[key]
            else:
                missing.append(key)
        if missing:
            young.update(zip(missing, self.make(missing), strict=True))
        return young
