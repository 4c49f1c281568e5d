"""URL filter: rules, and logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table and sent to the executors: 2^16 weights, 512 KB. The table is a DataFrame
of url and label (1: block), of which at most ``most`` rows are read, those with the smallest hashes, whatever their order; without one, a
built-in table made by rule stands in for it. ``accuracy`` judges each host by a model of the other hosts. Rules are column
expressions. Nothing is shuffled.

Defined results: a null url, or one without ``://``, has empty host and path; no rule fits it and the model judges the
empty host. Repeated rows get a row each. An empty table gives an empty result, an empty labelled table a model that allows nothing and blocks all (0.5). Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import LOWER, UPPER, lower_ascii

MOST_LABELLED = 10_000
DIMENSIONS = 1 << 16
SIZES = (3, 4, 5)
#: Words of the built-in labelled table.
BAD_WORDS = "casino poker bets betting slots jackpot pills viagra pharmacy cheap win free-bets loans payday adult xxx porn escort dating replica".split()
GOOD_WORDS = "news blog school museum library garden science weather music travel health history sports recipe forum shop wiki review photo city".split()
_ENDS = ("com", "net", "org")


def built_in_table() -> list[tuple[str, int]]:
    """A labelled table by rule: names of bad words alone and in pairs, and names of everyday words alone and in pairs or of plain syllables."""
    out = []
    syllables = ("th", "an", "er", "in", "re", "on", "at", "tion", "ing", "st", "es", "ble")
    many = len(BAD_WORDS)
    for k in range(many):
        end, lang = _ENDS[k % 3], ("en", "de", "fr", "es")[k % 4]
        plain = "".join(syllables[(k * s + s) % 12] for s in (1, 5, 7)[: 2 + k % 2])
        names = [(word, label) for label, words in ((1, BAD_WORDS), (0, GOOD_WORDS)) for word in (words[k], *(f"{words[k]}-{words[(k + step) % many]}" for step in (3, 7, 12)))]
        names += [(name, 0) for name in (plain, plain + syllables[k % 12], syllables[k % 12] + plain, plain + "al")]
        for number, front in enumerate(("", "www.", "m.", "blog.")):
            page = f"/{lang}/{(k * 37 + number * 911) % 9000}"
            out += [(f"http{'s' * (place % 2)}://{front}{name}.example.{end}{page}{'.html' * (place % 2)}", label) for place, (name, label) in enumerate(names)]
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("`_hz_u`"))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def split_urls(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path)."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("_hz_u"))
    host, path = host_and_path(F.col("_hz_u"))
    return rows.select(id_col, host.alias("host"), path.alias("path"))


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, and which row each belongs to; host and path have n-grams of their own."""
    found, owner = [], []
    for field, values in enumerate((hosts, paths)):
        raw = [b"\x02" + value.encode("utf-8", "surrogatepass") + b"\x03" for value in values]
        text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        for size in SIZES:
            if len(text) < size:
                continue
            value = np.zeros(len(text) - size + 1, np.uint64)
            for k in range(size):
                value = value * np.uint64(257) + text[k : len(text) - size + 1 + k]
            value = (value + np.uint64(size * 2 + field)) * np.uint64(0x9E3779B97F4A7C15)
            whole = row[: len(value)] == row[size - 1 :]
            found.append((value >> np.uint64(48)).astype(np.int64)[whole])
            owner.append(row[: len(value)][whole])
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def logits(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Sum of the weights of a row's n-grams, over the square root of their number, and the bias (the last weight)."""
    found, owner = features(hosts, paths)
    count = np.maximum(np.bincount(owner, minlength=len(hosts)), 1)
    return np.bincount(owner, weights[found], len(hosts)) / np.sqrt(count) + weights[DIMENSIONS]


def train(hosts: list[str], paths: list[str], labels: list[int], rounds: int = 400, rate: float = 16.0, decay: float = 1e-3) -> np.ndarray:
    """Weights by gradient descent on the mean logistic loss with L2 decay.

    A row's features have a sum of squares of about 1, and few rows share an n-gram, so that steps of ``rate`` times the mean gradient stay
    small for each weight; the bias, which all rows share, takes steps of 1.
    """
    found, owner = features(hosts, paths)
    y, n = np.asarray(labels, float), len(labels)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    weights = np.zeros(DIMENSIONS + 1)
    for _ in range(rounds if n else 0):
        error = y - 1 / (1 + np.exp(-(np.bincount(owner, weights[found], n) * scale + weights[DIMENSIONS])))
        weights[:DIMENSIONS] += rate * np.bincount(found, (error * scale)[owner], DIMENSIONS) / n - decay * weights[:DIMENSIONS]
        weights[DIMENSIONS] += error.mean()
    return weights


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a url, as host_and_path() gives them."""
    _, there, rest = url.partition("://")
    cut = re.match(r"(?s)([^/?#]*)([^?#]*)", rest if there else "")
    return cut[1].translate(str.maketrans(UPPER, LOWER)), cut[2]


def labelled_pairs(labelled: DataFrame | None = None, url_col: str = "url", label_col: str = "label", most: int = MOST_LABELLED) -> list[tuple[str, int]]:
    """(url, label) of a labelled table, at most ``most`` of them, or of the built-in one."""
    if labelled is None:
        return built_in_table()
    rows = labelled.select(F.coalesce(F.col(url_col), F.lit("")).alias("u"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL")
    return [(r.u, r.y) for r in rows.orderBy(F.xxhash64("u", "y"), "u", "y").limit(most).collect()]


def model(labelled: DataFrame | None = None, url_col: str = "url", label_col: str = "label", most: int = MOST_LABELLED) -> np.ndarray:
    """Train from a labelled table, or from the built-in one."""
    return trained(labelled_pairs(labelled, url_col, label_col, most))


def trained(pairs: list[tuple[str, int]]) -> np.ndarray:
    split = [split_url(url) for url, _ in pairs]
    return train([host for host, _ in split], [path for _, path in split], [label for _, label in pairs])


def accuracy(pairs: list[tuple[str, int]], folds: int = 5) -> float:
    """The share of urls that a model of the other folds' registered names judges as labelled; a name is the last three parts of a host."""
    name = lambda url: zlib.crc32(".".join(split_url(url)[0].split(".")[-3:]).encode("utf-8", "surrogatepass"))
    right = 0
    for fold in range(folds):
        weights = trained([p for p in pairs if name(p[0]) % folds != fold])
        held = [p for p in pairs if name(p[0]) % folds == fold]
        if held:
            split = [split_url(url) for url, _ in held]
            right += int(((logits(weights, [h for h, _ in split], [p for _, p in split]) >= 0) == np.array([y == 1 for _, y in held])).sum())
    return right / max(len(pairs), 1)


Rule = tuple[str, str]  # verdict, host and path


def matched_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(df: DataFrame, rules: list[Rule], weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict, probability (of block, by the model)."""
    rows = split_urls(df, id_col, url_col)
    kind = rows.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            chance = 1 / (1 + np.exp(-logits(sent.value, hosts, paths))) if hosts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=[id_col, "host", "path", "probability"])

    scored = rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, probability double")
    rule, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    by_model = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "probability")
