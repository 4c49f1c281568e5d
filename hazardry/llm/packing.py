"""Sequence packing by non-negative least squares over length combinations.

Documents are tokenised once, cut into windows of the sequence length and a remainder, and from then on only
(id, start, length, checksum) travels. The histogram of piece lengths has as many entries as the window
at most, whatever the corpus, so it is planned on the driver: shallow combinations (two or three distinct
lengths, with multiplicities) that fill a window exactly are the columns of a non-negative least-squares
problem against the histogram; its solution is rounded down to whole repeat counts, and what remains is
packed greedily (longest first, best fit), many equal windows at a time. The plan is a table of rank ranges
for each length, broadcast up to MOST_RANGES of them; a piece finds its sequence and offset from
its rank among the pieces of its length.

Ranks need no sort and no task that sees a whole length: the tokenising task numbers its own pieces of each length,
and the sums over the tasks before it are added by a join on (task, length).

Defined results: a null or empty text is one piece that holds only the end token. Repeated rows are packed
once each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardry.llm.common import TwoGenerations, blocks, materialise

WINDOW = 4096
#: Words that each generation of a worker's cache holds.
CACHED = 100_000
#: Characters that a worker tokenises at a time.
BLOCK = 1_000_000
#: Rank ranges that are broadcast at most (six longs each, 10 MB); beyond that the join is left to Spark.
MOST_RANGES = 200_000
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


#: Letters that composing leaves as they are and whose case changes one by one; marks that no special string or contraction begins or ends with.
MARKS = ".,;:!?#$%&*\"()+-/=@[]^_`{}~\\"
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([" + re.escape(MARKS) + "]*)")


def plain_parts(word: str) -> tuple[str, str] | None:
    """A plain word's Latin letters and the marks behind them."""
    if word.isascii():
        core = word.rstrip(MARKS)
        return (core, word[len(core) :]) if core.isalpha() else None
    parts = _PLAIN.fullmatch(word)
    return None if parts is None else parts.groups()


def _shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the others by the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_SHOWN = _shown_bytes()


def only_lowers(settings: dict) -> bool:
    """Whether a tokenizer's settings make letters lower-case, keep runs of them whole, write them by bytes, and change nothing else about them."""
    parts = (settings.get("normalizer") or {}).get("normalizers") or [settings.get("normalizer") or {}]
    kinds = {p.get("type") for p in parts if p.get("type") != "Replace" or p.get("pattern") != {"Regex": "\\s+"}}
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
    pattern = next((p["pattern"].get("Regex", "") for p in split if p.get("type") == "Split"), "")
    letters = pattern.split("|")
    apart = all(x.startswith("'") for x in letters[: letters.index(r"[\p{L}]+")]) if r"[\p{L}]+" in letters else False
    by_bytes = any(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in split)
    return kinds <= {"NFC", "Lowercase"} and "Lowercase" in kinds and apart and by_bytes and settings["model"].get("type") == "BPE" and settings.get("post_processor") is None


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, word by word with a cache.

    No token of such a vocabulary spans a blank or a line end, and neither does a special string, so a text's ids are those of its
    blank-separated words, one after the other. Special strings get their own ids, as the library gives them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = only_lowers(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # each word comes once
        self.words, self.cores = TwoGenerations(self.encode, CACHED), TwoGenerations(self.encode_cores, CACHED)
        self.tails: dict[str, bytes] = {"": b""}

    def encode(self, found: list[str]) -> list[bytes]:
        """Ids of words.

        Where the normaliser and the splitter only lower the case of letters and part marks from them, plain words (Latin letters, then
        marks) go to the tokenizer's model directly, each spelling without case and marks once.
        """
        # letters alone, or with marks behind; of ASCII words that is seen without the expression
        cores = [word.lower() if word.isascii() and word.isalpha() else None for word in found] if self.lowers else [None] * len(found)
        others, marked = [], []
        for k in [k for k, core in enumerate(cores) if core is None]:
            parts = plain_parts(found[k]) if self.lowers else None
            if parts is None:
                others.append(k)
            else:
                cores[k] = parts[0].lower()
                if parts[1]:
                    marked.append((k, parts[1]))
        plain = set(cores)
        plain.discard(None)
        known = self.cores.of(plain)
        out: list[bytes] = [b"" if core is None else known[core] for core in cores]
        for k, tail in marked:
            out[k] += self.tails[tail] if tail in self.tails else self.tail(tail)
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for k, x in zip(part, self.tokenizer.encode_batch_fast([found[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = array("I", x.ids).tobytes()
        return out

    def tail(self, marks: str) -> bytes:
        """Ids of marks behind a word."""
        if len(self.tails) > 1000:
            self.tails = {"": b""}
        self.tails[marks] = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
        return self.tails[marks]

    def encode_cores(self, found: list[str]) -> list[bytes]:
        """Ids of lower-case words of Latin letters."""
        tokenize = self.model.tokenize
        shown = (core if core.isascii() else core.encode().decode("latin-1").translate(_SHOWN) for core in found)
        return [array("I", [x.id for x in tokenize(core)]).tobytes() for core in shown]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        get = self.words.of({word for row in split for word in row}).__getitem__
        return [b"".join(map(get, row)) for row in split]


_ENCODERS: dict[str, WordTokenizer] = {}


def encoder_of(path: str) -> WordTokenizer:
    """The tokenizer of this Python process; a reused worker finds the words of its earlier tasks in it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokenizer(path)
    return _ENCODERS[path]


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Tokenise and cut: id, start, length, ids_crc32, doc_tokens, and the task and the rank within it."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_hz_t"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, part, seen = encoder_of(vocabulary), TaskContext.get().partitionId(), Counter()
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at, texts in blocks(batch.column(1).to_pylist(), BLOCK):
                took, cols = [], [[], [], [], [], []]
                for k, ids in enumerate(encoder.ids(texts)):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        took.append(at + k)
                        for col, value in zip(cols, (start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, seen[length]), strict=True):
                            col.append(value)
                        seen[length] += 1
                start, length, crc, total, nth = (pa.array(c, pa.int64()) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(took, pa.int64())), start, length, crc, total, pa.array([part] * len(took), pa.int32()), nth],
                    names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {_PIECES}")


Combination = tuple[tuple[int, int], ...]  # (length, how often), ...


def combinations(histogram: dict[int, int], window: int = WINDOW, each: int = 12) -> list[Combination]:
    """Shallow combinations of existing lengths that fill the window exactly: up to three distinct lengths."""
    lengths = sorted(histogram)
    there = set(lengths)
    found: set[Combination] = set()

    def add(*parts: tuple[int, int]) -> int:
        merged: Counter = Counter()
        for length, times in parts:
            merged[length] += times
        if all(histogram[x] >= n for x, n in merged.items()):
            before = len(found)
            found.add(tuple(sorted(merged.items(), reverse=True)))
            return len(found) - before
        return 0

    for a in lengths:
        own = 0
        top = min(histogram[a], window // a)
        for times in range(top, 0, -1):
            rest = window - a * times
            if rest == 0:
                own += add((a, times))
            elif rest in there:
                own += add((a, times), (rest, 1))
            else:
                # a third length: the partners that split the rest, the most frequent first
                for b in sorted((b for b in lengths if b < rest and rest - b in there), key=lambda x: -histogram[x])[:3] if own < each else ():
                    own += add((a, times), (b, 1), (rest - b, 1))
            if own >= each:
                break
    return sorted(found)


def nnls(columns: list[Combination], histogram: dict[int, int], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|: multiplicative updates, which keep x non-negative.

    Rows are weighted by 1/h, so that rare lengths count as much as frequent ones.
    """
    if not columns:
        return np.zeros(0)
    place = {x: k for k, x in enumerate(histogram)}
    row = np.array([place[x] for c in columns for x, _ in c])
    col = np.array([k for k, c in enumerate(columns) for _ in c])
    a = np.array([n for c in columns for _, n in c], float)
    h = np.array([histogram[x] for x in histogram], float)
    w = 1 / h
    n, m = len(columns), len(h)
    x = np.full(n, h.sum() / n / a.sum() * n)
    atb = np.bincount(col, a * w[row] * h[row], n)
    for _ in range(rounds):
        ax = np.bincount(row, a * x[col], m)
        x *= atb / np.maximum(np.bincount(col, a * w[row] * ax[row], n), 1e-12)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[Combination, int]]:
    """Combinations and whole repeat counts that use every piece exactly once."""
    import bisect

    left = {x: n for x, n in histogram.items() if n > 0}
    out: list[tuple[Combination, int]] = []

    def use(combination: Combination, times: int) -> None:
        times = min([times, *(left.get(x, 0) // n for x, n in combination)])
        if times > 0:
            out.append((combination, times))
            for x, n in combination:
                left[x] -= times * n

    columns = combinations(left, window)
    solved = nnls(columns, left)
    for k in np.argsort(-solved, kind="stable"):
        use(columns[k], int(solved[k]))
    lengths = sorted(x for x, n in left.items() if n)
    while lengths:
        taken, rest, most = Counter(), window, len(lengths)
        while most:
            x = lengths[most - 1]
            if x > rest or taken[x] >= left[x]:
                most = min(most - 1, bisect.bisect_right(lengths, rest))
                continue
            fits = min(rest // x, left[x] - taken[x])
            taken[x] += fits
            rest -= fits * x
        use(tuple(sorted(taken.items(), reverse=True)), max(left.values()))
        lengths = [x for x in lengths if left[x]]
    return out


def rank_ranges(plan_rows: list[tuple[Combination, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, times, sequence base, offset base): the ranks of a length that a combination takes."""
    used, sequence, out = Counter(), 0, []
    for combination, repeats in plan_rows:
        offset = 0
        for length, times in combination:
            out.append((length, used[length], used[length] + repeats * times, times, sequence, offset))
            used[length] += repeats * times
            offset += length * times
        sequence += repeats
    return out


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    cut = materialise(pieces(df, vocabulary, id_col, text_col, end_id, window), "pieces")
    tasks = materialise(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()}  # at most `window` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(tasks.select("part", "length", F.coalesce(before, F.lit(0)).alias("_hz_before")), "piece-offsets")
    planned = rank_ranges(plan(histogram, window))
    ranges = spark.createDataFrame(planned, "length long, _hz_lo long, _hz_hi long, _hz_times long, _hz_base long, _hz_offset long")
    if len(planned) <= MOST_RANGES:
        ranges = F.broadcast(ranges)
    ranked = cut.join(offsets, ["part", "length"]).withColumn("_hz_rank", F.col("nth") + F.col("_hz_before"))
    inside = (ranked["length"] == ranges["length"]) & (F.col("_hz_rank") >= F.col("_hz_lo")) & (F.col("_hz_rank") < F.col("_hz_hi"))
    placed = ranked.join(ranges, inside).drop(ranges["length"])
    step = F.col("_hz_rank") - F.col("_hz_lo")
    return placed.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_hz_base") + F.expr("(_hz_rank - _hz_lo) div _hz_times")).cast("long").alias("sequence_id"),
        (F.col("_hz_offset") + F.pmod(step, F.col("_hz_times")) * F.col("length")).cast("long").alias("offset"),
    )
