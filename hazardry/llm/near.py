"""Near-duplicate detection by Order MinHash and banded alignment.

1. Equal word sequences are one class, known by a 128-bit digest; only class representatives go on.
2. A text's shingles are its windows of five words, labelled by occurrence, so that repeats count. A sketch
   takes, under one random order, the four smallest shingles and keeps them in the order of the text;
   two texts share a sketch with about the fourth power of their similarity, and only if the order agrees.
   Twenty sketches miss a pair at 0.8 about once in 40,000. Short texts (4 to 30 shingles) are also known by their smallest shingles one by
   one, so many that two texts at 0.8 must share one: among texts of up to 24 shingles, and between those and others, no pair is missed.
   Texts whose numbers of shingles differ by more than a factor of 1/0.8 can't be similar: a bucket is a sketch and a class of
   lengths, and a text is in its own class and the next; a bucket without texts of its own class is met elsewhere and left out.
3. Texts of a bucket are aligned with its leader, the smallest id, which is linear in a bucket's size. Only buckets whose texts
   still lie in different components are then closed, exactly: their texts meet in blocks, the common shingles of every pair of
   different components are counted through an inverted index (at the first bucket that the pair shares, so once), and what can be similar is
   aligned unless an earlier link has joined the two. A task sends the links it finds, never pairs. The largest component of
   a bucket is dealt once for each block of the rest, so a hot group of copies costs about its own size.
   Aligned means: the longest common subsequence of the shingle sequences in the band that a similarity of 0.8 allows,
   bit-parallel; similarity is common / (a + b - common).
4. Components of the links by alternating large-star and small-star steps, all of it distributed.

Buckets, classes and hub nodes may hold any share of the rows: they are combined before shuffles, and met by joins
that adaptive execution can split; intermediate tables are written to the shared folder.

Defined results: texts are compared by A-Z lower-cased words. Texts of fewer than five words have one shingle.
Texts without words are all equal. Ids are whole numbers; a null id takes no part and is its own class. Rows that repeat an
id are one document whose smallest text stands for it. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import LOWER, UPPER, materialise, unused, without_repeats

SHINGLE, SIMILARITY, SKETCHES, KEPT = 5, 0.8, 20, 4
#: Numbers of shingles: below the first no other text is similar; up to the second smallest shingles are buckets; from the third sketches are.
LEAST, SHORT, LONG = 4, 30, 25
#: Texts and shingles of a block.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
_TABLE = str.maketrans(UPPER + "\t\n\x0b\x0c\r", LOWER + 5 * " ")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(text: str | None) -> list[str]:
    """Words of a text, A-Z lower-cased."""
    return [word for word in text.translate(_TABLE).split(" ") if word] if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class WordHashes:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self, most: int = 100_000):
        self.cache: dict[str, int] = {}
        self.most = most

    def __call__(self, found: list[str]) -> np.ndarray:
        import xxhash

        if len(self.cache) > self.most:
            self.cache = {}
        cache = self.cache
        for word in set(found):
            if word not in cache:
                cache[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash for each window of five words (one for a shorter text)."""
    size = min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k]
    return _mix(out)


def occurrence_labelled(shingles: np.ndarray) -> np.ndarray:
    """The same hashes, with the second, third ... occurrence of each changed by its number."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    starts = np.r_[True, ranked[1:] != ranked[:-1]]
    if starts.all():
        return shingles
    place = np.arange(len(ranked))
    number = place - np.maximum.accumulate(np.where(starts, place, 0))
    out = shingles.copy()
    out[order] = np.where(number > 0, _mix(ranked + number.astype(np.uint64) * _M1), ranked)
    return out


def sketches(shingles: np.ndarray) -> np.ndarray:
    """Order MinHash of a text's shingles: one hash for each sketch."""
    labelled = occurrence_labelled(shingles)
    if not len(labelled):
        return np.zeros(0, np.uint64)
    keep = min(KEPT, len(labelled))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, 2_000_000 // len(labelled))
    for at in range(0, SKETCHES, step):  # a very long text goes one order at a time
        ranks = _mix(labelled[None, :] ^ _SEEDS[at : at + step, None])
        least = np.argpartition(ranks, keep - 1, axis=1)[:, :keep] if keep < len(labelled) else np.tile(np.arange(keep), (len(ranks), 1))
        chosen = labelled[np.sort(least, axis=1)]
        found = np.zeros(len(ranks), np.uint64)
        for k in range(keep):
            found = _mix(found * _M2 + chosen[:, k])
        out[at : at + step] = found
    return out


def smallest(shingles: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The smallest shingles of a short text, as many as make two similar texts share one.

    Similar texts of a and b shingles have at least `least` * max(a, b) in common, so each lacks fewer of them than are kept here.
    """
    labelled = occurrence_labelled(shingles)
    return np.sort(labelled)[: len(labelled) - int(np.ceil(least * len(labelled) - 1e-9)) + 1]


def needed(total, least: float = SIMILARITY):
    """The common shingles without which two texts of `total` shingles together are not similar."""
    return np.ceil(least * total / (1 + least) - 1e-9)


def _places(a: list) -> dict:
    """Where each symbol stands: the first place and, for symbols that stand densely, bits from there; else a list. Linear in memory."""
    found: dict = {}
    for j, x in enumerate(a):
        if x in found:
            found[x].append(j)
        else:
            found[x] = [j]
    out: dict = {}
    for x, places in found.items():
        first, span = places[0], places[-1] - places[0] + 1
        if span == 1:
            out[x] = (first, 1)
        elif span <= 64 * len(places):
            bits = np.zeros(span, np.uint8)
            bits[np.array(places) - first] = 1
            out[x] = (first, int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        else:
            out[x] = places
    return out


def common_in_band(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose path stays within `band` of the diagonal.

    Bit-parallel: bit j of the window is 0 where the table grows at column j; the window slides with the row.
    """
    places = _places(a)
    n, wide = len(a), 2 * band + 1
    mask, lo, window, grown = (1 << wide) - 1, -band, (1 << wide) - 1, 0
    for x in b:
        at = places.get(x)
        if at is None:
            here = 0
        elif isinstance(at, tuple):
            first, bits = at
            here = (bits << (first - lo) if first >= lo else bits >> (lo - first)) & mask if first < lo + wide else 0
        else:
            here = sum(1 << (j - lo) for j in at[bisect_left(at, lo) : bisect_left(at, lo + wide)])
        step = window & here
        window = ((window + step) | (window - step)) & mask
        grown += 1 - (window & 1) if 0 <= lo < n else 0
        window = (window >> 1) | (1 << (wide - 1))
        lo += 1
    inside = range(max(0, -lo), min(wide, n - lo))
    return grown + sum(1 for k in inside if not window >> k & 1)


def aligned(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the banded alignment of two shingle sequences reaches the similarity."""
    total, short = len(x) + len(y), min(len(x), len(y))
    need = int(needed(total, least))
    if short < need:
        return False
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(x[len(x) - short + head :][::-1] != y[len(y) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    if head + tail >= need:
        return True
    rest = common_in_band(x[head : len(x) - tail].tolist(), y[head : len(y) - tail].tolist(), total - 2 * need + 1)
    return head + tail + rest >= need


class Shingled:
    """A text's shingles in order, and labelled and sorted."""

    def __init__(self, text: str | None, hashes: WordHashes):
        self.order = shingle_hashes(hashes(tokens(text)))
        self.labelled = np.sort(occurrence_labelled(self.order)) if len(self.order) else self.order

    def similar(self, other: Shingled, least: float = SIMILARITY) -> bool:
        """Whether two texts reach the similarity; texts without words are similar to each other."""
        a, b = len(self.order), len(other.order)
        if not a or not b:
            return a == b
        need = needed(a + b, least)
        if min(a, b) < need or len(np.intersect1d(self.labelled, other.labelled, assume_unique=True)) < need:
            return False
        return aligned(self.order, other.order, least)


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the words, number of shingles, sketches, smallest shingles of short texts) for each row with an id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, none = WordHashes(), np.zeros(0, np.int64)
        for batch in batches:
            keys, counts, found, small = [], [], [], []
            for value in batch.column(1):
                row = tokens(value.as_py())
                keys.append(hashlib.blake2b(" ".join(row).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                n = max(len(row) - SHINGLE + 1, min(len(row), 1))
                shingles = shingle_hashes(hashes(row)) if n >= LEAST else none
                counts.append(n)
                found.append(sketches(shingles).view(np.int64) if n >= LONG else none)
                small.append(smallest(shingles).view(np.int64) if LEAST <= n <= SHORT else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, longs), pa.array(small, longs)],
                names=["id", "key", "shingles", "sketches", "smallest"],
            )

    return rows.mapInArrow(run, "id long, key binary, shingles long, sketches array<long>, smallest array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of (a, b), those whose texts are similar. texts: (id, text), one row for each id."""
    first = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, own = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if own is None or known != a:
                    known, own = a, Shingled(x.as_py(), hashes)
                keep.append(own.similar(Shingled(y.as_py(), hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in the links (a, b); a component is named by its smallest id."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges")
    while True:
        # large-star: every larger neighbour of u meets u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        # small-star: u and its smaller neighbours meet the smallest of them
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "least")
        moved = large.join(least.filter("k > 1"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        # stars already: every id has one smaller neighbour, which has none itself
        tops = least.select(F.col("m").alias("u")).distinct()
        if least.filter("k > 1").limit(1).isEmpty() and least.join(tops, "u", "left_semi").limit(1).isEmpty():
            return small.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops.select(F.col("u").alias("id"), F.col("u").alias("component")))
        edges = small


def length_class(n):
    return F.floor(F.log(n) / F.lit(-float(np.log(SIMILARITY)))).cast("int")


def bucketed(classes: DataFrame) -> DataFrame:
    """(bucket, id, n, band, level): a bucket is a sketch (or a smallest shingle) and a length class, its level; each text is in its class and the next."""
    keys = F.concat(
        F.transform("sketches", lambda x, k: F.struct(k.alias("band"), x.alias("x"))), F.transform("smallest", lambda x: F.struct(F.lit(SKETCHES).alias("band"), x.alias("x")))
    )
    rows = classes.filter(f"shingles >= {LEAST}").select(F.col("rep").alias("id"), F.col("shingles").alias("n"), F.explode(keys).alias("k"))
    levels = rows.select("id", "n", "k.band", "k.x", F.explode(F.array(length_class("n"), length_class("n") + 1)).alias("level"))
    return levels.select(F.xxhash64("band", "x", "level").alias("bucket"), "id", "n", "band", "level")


def linked_in_square(ids, block, component, n, level: int, band: int, lo: int, hi: int, sketched_rows: list, texts: list, hashes: WordHashes) -> list[tuple[int, int]]:
    """Links that join all similar texts of two blocks (or one) of a bucket.

    Every pair of different components whose first common bucket this is gets counted; see the module's third step.
    """
    found = [Shingled(text, hashes) for text in texts]
    sizes = np.array([len(x.order) for x in found])
    owner = np.repeat(np.arange(len(found)), sizes)
    _, symbol = np.unique(np.concatenate([x.labelled for x in found]), return_inverse=True)
    by_symbol = np.argsort(symbol, kind="stable")
    posted, ends = owner[by_symbol], np.cumsum(np.bincount(symbol))
    starts = np.r_[0, ends[:-1]]
    heads = np.r_[0, np.cumsum(sizes)]
    own_class = np.floor(np.log(n) / -np.log(SIMILARITY)).astype(int)
    marks = np.array([x if len(x) == SKETCHES else [0] * SKETCHES for x in sketched_rows], np.int64)[:, : band if band < SKETCHES else 0]
    root = np.unique(component, return_inverse=True)[1]
    main = root == np.bincount(root).argmax()  # as it was; components grow meanwhile
    links = []
    for k in np.flatnonzero((block == lo) if lo != hi else ~main):
        others = (root != root[k]) & (block == hi) & (np.maximum(own_class, own_class[k]) == level)
        if lo == hi:  # a pair of two that are walked through is met at the first
            others[:k] &= main[:k]
        met = np.flatnonzero(others)
        need = needed(n[k] + n[met])
        fits = np.minimum(n[met], n[k]) >= need
        if marks.shape[1]:
            fits &= ~(marks[met] == marks[k]).any(axis=1)
        met, need = met[fits], need[fits]
        if not len(met):
            continue
        common = np.bincount(np.concatenate([posted[starts[s] : ends[s]] for s in symbol[heads[k] : heads[k + 1]]]), minlength=len(found))[met]
        for j in met[common >= need][np.argsort(-common[common >= need], kind="stable")]:
            if root[j] != root[k] and aligned(found[k].order, found[j].order):
                links.append((int(min(ids[k], ids[j])), int(max(ids[k], ids[j]))))
                root[root == root[j]] = root[k]
    return links


def closed(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join all similar texts within each bucket. apart: (bucket, id, n, band, level, c), c the component; texts: (id, text, sketches)."""
    held = materialise(apart.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("words")), "bucket-components")
    blocks = lambda rows, words: F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(words / F.lit(BLOCK_SHINGLES))).cast("int")
    whole = held.groupBy("bucket").agg(F.sum("k").alias("rows"), F.sum("words").alias("words"), F.max(F.struct("k", "c", "words")).alias("main"))
    whole = whole.select(
        "bucket", F.col("main.c").alias("main"), (blocks(F.col("rows"), F.col("words")) == 1).alias("one"),
        F.greatest(blocks(F.col("rows") - F.col("main.k"), F.col("words") - F.col("main.words")), F.lit(1)).alias("rest"), blocks(F.col("main.k"), F.col("main.words")).alias("mains"),
    )
    rows = apart.join(materialise(whole, "bucket-plans"), "bucket")
    in_main = ~F.col("one") & (F.col("c") == F.col("main"))
    drawn = lambda many: F.pmod(F.xxhash64("id", F.lit(1)), many).cast("int")
    block = F.when(F.col("one"), F.lit(0)).when(in_main, F.col("rest") + drawn(F.col("mains"))).otherwise(drawn(F.col("rest")))
    last = F.when(F.col("one"), F.lit(0)).when(in_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1)
    rows = rows.select("bucket", "id", "n", "band", "level", "c", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "n", "band", "level", "c", "block")
    rows = rows.join(texts, "id").select("bucket", "lo", "hi", "id", "n", "band", "level", "c", "block", "sketches", "text")
    dealt = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[pa.RecordBatch] = []
        last = None

        def square() -> pa.RecordBatch:
            group = pa.Table.from_batches(held)
            ids, n, band, level, c, block = (group.column(k).to_numpy() for k in ("id", "n", "band", "level", "c", "block"))
            links = linked_in_square(ids, block, c, n, int(level[0]), int(band[0]), last[1], last[2], group.column("sketches").to_pylist(), group.column("text").to_pylist(), hashes)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            starts = np.r_[0, 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))]
            for at, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
                key = tuple(int(x) for x in keys[:, at])
                if held and key != last:
                    yield square()
                    held = []
                held.append(batch.slice(at, end - at))
                last = key
        if held:
            yield square()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, class_id (the smallest id of its group), kept (whether it is that one)."""
    rows = materialise(sketched(df, id_col, text_col), "sketches")
    classes = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("shingles").alias("shingles"), F.first("sketches").alias("sketches"), F.first("smallest").alias("smallest"))
    classes = materialise(classes, "classes")
    placed = bucketed(classes)
    crowded = placed.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size"), F.max(length_class("n") == F.col("level")).alias("own")).filter("size > 1 AND own")
    members = materialise(placed.join(materialise(crowded.select("bucket", "leader", "size"), "buckets"), "bucket"), "bucket-members")
    named = members.select("id").distinct().join(classes.select(F.col("rep").alias("id"), "sketches"), "id")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(named.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts = materialise(texts.join(named, "id"), "bucket-texts")

    pairs = members.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).filter("a <> b").distinct()
    links = materialise(verified(pairs, texts), "links")
    found = materialise(components(links), "components")
    # buckets of two are settled by now
    inside = members.filter("size > 2").join(found, "id", "left").select("bucket", "id", "n", "band", "level", F.coalesce("component", "id").alias("c"))
    open_buckets = materialise(inside.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("bucket"), "open-buckets")
    more = materialise(closed(inside.join(open_buckets, "bucket", "left_semi"), texts), "links")
    if not more.limit(1).isEmpty():
        found = materialise(components(links.unionByName(more)), "components")

    # classes whose name isn't simply each row's own id
    named = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").filter("n > 1 OR component IS NOT NULL")
    named = materialise(named.select("key", F.coalesce("component", "rep").alias("class_id")), "class-names")
    out = rows.select("id", "key").join(named, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    lone = df.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(lone).select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with the columns that came in; rows that repeat an id leave the one with the smallest text."""
    name = unused(df, "_hz_dropped")
    dropped = near_groups(df, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    dropped = materialise(dropped, "near-dropped")
    return without_repeats(df.join(dropped, F.col(id_col) == F.col(name), "left_anti"), [id_col], F.col(text_col))
