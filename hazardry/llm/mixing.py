"""Language-model scoring by logistic context mixing.

A text is coded bit by bit. Seven predictors, of 0 to 5 preceding bytes and of the current word's beginning, each hash their context (and the
byte's first half, once that is known) to a row of sixteen slots, one for each sequence of bits so far; a slot remembers how many zeros
and ones followed, as a coded pair of one byte. An adaptive map for each order turns a slot's pair
into a probability, a gated mixer adds their logits with weights chosen by bit place and longest known context, and a
final adaptive map refines the mix. The bits' log-probabilities add up to that of the text.

Training, all distributed, over every training text:
1. sites (a byte, the five before it and a hash of the word's beginning) are counted in each task, then across tasks (what is shuffled grows with the
   corpus). They are dealt to shards by their hash and sorted, a shard being one row; the number of shards follows from the corpus alone, one for a million tokens;
2. distinct sites are expanded to slots; a task sends its slots' counts as compressed blocks, which are added up in two steps, as many
   halves as the root of the number of tasks. Rows are as many as the distinct sites (to the next power of two), up to 2^MOST_BITS an order, since every worker holds the tables (85 MB then);
3. the adaptive maps are counted, each site seen without its own occurrence, so that they show what slots say of new text;
4. mixer weights learn online in each shard, by steps down the coding cost, and are averaged over the shards; the final
   map counts on the way. All sums over tasks are whole numbers, so neither partitions nor the order of tasks change the model.
The tables are sent to the workers once, compressed; maps and weights travel with the tasks. Counts are added by ranges of sites and spans of slots, so that a worker copies little.
Scoring prices a site once for as long as it stays in a process's table of known sites. Nothing learns from a text while it is scored.

The unigram base: words count in each task first; frequent words (more than one token in
1,000,000, hence at most 1,000,000 words) go to all tasks by broadcast, all others are joined.

Texts are walked in stretches of about half a million bytes, which end after a blank, so a long text (but for a single endless word) takes no more memory than a short one.

Defined results: a null or empty text is coded as the end sign alone. A null id counts as text "" for the fold. Rows that repeat
are scored, and learnt from, once each. Without training texts every probability comes from the untrained model,
and the base score is 0, as its formula says. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import lower_ascii, materialise, trim

BYTES = 6  # a site is a byte and the five before it, and above them 16 bits of a hash of the current word up to there
ORDERS = BYTES + 1  # contexts of 0 to 5 bytes, and the current word's beginning
MOST_BITS = 20
END = 255  # no byte of UTF-8
#: Counts that a slot can tell apart; a coded pair is 16 * code of zeros + code of ones.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 512, 4096])
FREQUENT = 1_000_000
SHARD_TOKENS = 1_000_000
RATE = 4.0
BUCKETS = 24
GATES = 8 * ORDERS
STRETCH = 500_000
TEXT_BLOCK = 3_000_000
CHUNK, STEP = 8192, 1024
#: Sites of a batch that a task sends, and bytes of a table that are compressed at a time.
SENT, PIECE = 1 << 19, 1 << 22
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_HASHED = ORDERS - 2  # orders 0 and 1 have rows of their own
_DIRECT = 257 * 17  # rows of order 1, then of order 0: one for each first half of a byte, and one before it
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
#: The bytes that part words, and those with the padding before a text.
BLANKS = (9, 10, 11, 12, 13, 32)
_PARTS_WORDS = np.isin(np.arange(256), BLANKS)
_BLANK = np.isin(np.arange(256), [0, *BLANKS])
#: How many of two bytes (the later one lowest) belong to the word that ends with them.
_IN_WORD = np.where(_BLANK[np.arange(1 << 16) & 255], 0, np.where(_BLANK[np.arange(1 << 16) >> 8], 1, 2)).astype(np.uint8)
#: The hash of a word's beginning, and so many of its last bytes.
_WORD_MASK = np.array([(0xFFFF << 40) | ((1 << (8 * k)) - 1) for k in range(BYTES)], np.uint64)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def distinct(sites: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sites, sorted, and how often each occurs (or the sum of its n)."""
    if n is None:
        ranked = np.sort(sites)
    else:
        order = np.argsort(sites, kind="stable")
        ranked, n = sites[order], n[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    total = np.diff(np.r_[starts, len(ranked)]) if n is None else np.add.reduceat(n, starts) if len(starts) else n
    return ranked[starts], total.astype(np.int64)


def placed(sites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sites, and where each site is among them."""
    coded = pa.array(sites.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()


def text_blocks(column: pa.Array, most: int = TEXT_BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` bytes, with the place of the first; only a run at a time leaves Arrow's memory."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


Stretch = tuple[int, bytes, bytes, bool]  # number of the text, the five bytes before, the bytes, whether the text ends


def stretches(texts: list[str], most: int = STRETCH) -> Iterator[list[Stretch]]:
    """Groups of stretches of about `most` bytes; a text is cut after a blank only."""
    held: list[Stretch] = []
    size = 0
    for k, text in enumerate(texts):
        raw, at, before = text.encode("utf-8", "surrogatepass"), 0, b"\0" * 5
        while at <= len(raw):
            cut = len(raw)
            if cut - at > most:
                cut = 1 + max(raw.rfind(bytes([x]), at, at + most) for x in BLANKS)
                if not cut:
                    cut = 1 + min((y for x in BLANKS if (y := raw.find(x, at)) >= 0), default=len(raw))
                cut = min(cut, len(raw))
            last = cut == len(raw)
            held.append((k, before, raw[at:cut], last))
            size += cut - at + 6
            if size >= most:
                yield held
                held, size = [], 0
            before, at = (before + raw[at:cut])[-5:], cut if not last else len(raw) + 1
    if held:
        yield held


def _powers(size: int) -> list[np.ndarray]:
    """The powers of _P and of its inverse, kept from block to block."""
    if len(_POWERS[0]) < size:
        for k, base in enumerate((_P, _P_INVERSE)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[k] = np.cumprod(powers)
    return [x[:size] for x in _POWERS]


def sites_of(group: list[Stretch]) -> tuple[np.ndarray, np.ndarray]:
    """All sites of the stretches (the current byte lowest, the hash of the word's beginning highest; the end of a text is one), and where each stretch starts."""
    whole = b"\0\0" + b"".join(before + raw + b"\xff" * last for _, before, raw, last in group)
    joined = np.frombuffer(whole, np.uint8)[2:]
    size = len(joined)
    # eight bytes at each place, the last one lowest; of the first five places no site is kept
    sites = np.zeros(size, np.uint64)
    sites[5:] = np.ndarray((size - 5,), ">u8", whole, 0, (1,))
    sites &= np.uint64((1 << 48) - 1)
    # the word's beginning: a polynomial hash of the bytes since the last blank, from differences of a running sum
    power, inverse = _powers(size + 1)
    running = np.zeros(size + 1, np.uint64)
    np.cumsum(joined * power[:-1], out=running[1:])
    starts = np.r_[0, 1 + np.flatnonzero(_BLANK[joined])]
    lengths = np.diff(np.r_[starts, size + 1])
    words = (running - np.repeat(running[starts], lengths)) * np.repeat(inverse[starts], lengths)
    words = words[:-1]
    words = (words ^ (words >> np.uint64(29))) * _K2
    sites |= (words >> np.uint64(48)) << np.uint64(48)
    lengths = np.array([len(raw) + last for _, _, raw, last in group])
    keep = np.ones(size, bool)
    heads = np.cumsum(lengths + 5) - (lengths + 5)
    for k in range(5):
        keep[heads + k] = False
    return sites[keep], np.cumsum(lengths) - lengths


def words_in(group: list[Stretch]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the stretches, and each word's stretch."""
    joined = np.frombuffer(b" ".join(raw for _, _, raw, _ in group), np.uint8)
    inside = ~_PARTS_WORDS[joined]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    sizes = np.array([len(raw) + 1 for _, _, raw, _ in group])
    return values.dictionary_encode(), np.searchsorted(np.cumsum(sizes), starts, "right")


def words_of(sites: np.ndarray) -> np.ndarray:
    """The current word's beginning: its hash and those of the five bytes before that belong to it."""
    context = sites >> np.uint64(8)
    near, far = (_IN_WORD[((context >> np.uint64(k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in (0, 16))
    first = ~_BLANK[((context >> np.uint64(32)) & np.uint64(255)).astype(np.int64)]
    return context & _WORD_MASK[near + (near == 2) * (far + (far == 2) * first)]


def slots(bits: int) -> int:
    """How many slots the tables have."""
    return ((_HASHED << bits) + _DIRECT) << 4


def first_slots(sites: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first slot of each site's two rows, before and after the first half of its byte."""
    half = (sites >> np.uint64(4)) & np.uint64(15)
    if order < 2:
        row = (_HASHED << bits) + (((sites >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * 17 if order else 256 * 17)
        return np.broadcast_to(row << 4, len(sites)), (row + 1 + half.astype(np.int64)) << 4
    context = words_of(sites) if order == BYTES else (sites >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    mixed = (context + np.uint64(order << 58)) * _K1
    mixed ^= mixed >> np.uint64(31)
    shift, top = np.uint64(64 - bits), (order - 2) << bits
    before, after = mixed * _K2, (mixed + (half + np.uint64(1)) * _K3) * _K2
    after = (after ^ (after >> np.uint64(32))) * _K2
    return (((before >> shift).astype(np.int64) + top) << 4), (((after >> shift).astype(np.int64) + top) << 4)


def bits_of(sites: np.ndarray, places: range = range(8)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the eight bits: its place, the node (1 and the bits before), the bit."""
    byte = (sites & np.uint64(255)).astype(np.int64)
    for place in places:
        yield place, (1 << place) | (byte >> (8 - place)), (byte >> (7 - place)) & 1


def node_in_row(place: int, node: np.ndarray) -> np.ndarray:
    """Which slot of its row a node has."""
    return node if place < 4 else (1 << (place - 4)) | (node & ((1 << (place - 4)) - 1))


def code(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right") - 1


def coded_pairs(counts: np.ndarray) -> np.ndarray:
    """One byte for each row (zeros, ones); counts beyond the last level keep their ratio."""
    scale = np.maximum(counts.max(axis=1, keepdims=True) / LEVELS[-1], 1)
    kept = np.where(counts > 0, np.maximum(counts / scale, 1), 0)
    return (code(kept[:, 0]) * 16 + code(kept[:, 1])).astype(np.uint8)


#: By pair and bit: which of 2^32 chances make the count of the bit fall a level (0: it has none), and what its fall takes from the pair.
_LEVEL = np.where(np.arange(2)[None, :] == 1, np.arange(256)[:, None] & 15, np.arange(256)[:, None] >> 4)
_FALLS = np.where(_LEVEL > 0, (1 << 32) // np.minimum(np.diff(np.r_[LEVELS, 1 << 32])[_LEVEL], 1 << 32), 0).ravel()
_FALL = np.tile([16, 1], 256)


def without_own(pairs: np.ndarray, bit: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The pairs as if the site's own bit had not been counted.

    A level stands for several counts, one less of which falls below it in one case of as many; `chance`, 32 bits of a hash of the site, decides.
    """
    key = pairs * 2 + bit
    return pairs - (chance < _FALLS.take(key)) * _FALL.take(bit)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """Tables, maps and weights; logits[order][pair], weights[order and bias][gate], refined[node and bucket]."""

    bits: int
    table: np.ndarray
    logits: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def __getstate__(self) -> dict[str, Any]:
        """Tables travel compressed, by pieces: broadcasts lie on every executor's disk."""
        pieces = [self.table[at : at + PIECE] for at in range(0, len(self.table), PIECE)]
        return self.__dict__ | {"table": [(len(x), pa.compress(x.tobytes(), "zstd", asbytes=True)) for x in pieces]}

    def __setstate__(self, state: dict[str, Any]) -> None:
        pieces = state.pop("table")
        self.__dict__.update(state, table=np.empty(sum(size for size, _ in pieces), np.uint8))
        at = 0
        while pieces:
            size, packed = pieces.pop(0)
            self.table[at : at + size] = np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8)
            at += size

    def maps(self) -> tuple[np.ndarray, ...]:
        """All but the tables, a copy."""
        return tuple(x.copy() for x in (self.logits, self.weights, self.refined))

    def with_maps(self, maps: tuple[np.ndarray, ...]) -> Model:
        """The same tables with other maps and weights."""
        return Model(self.bits, self.table, *maps)

    def lookups(self, sites: np.ndarray, leave_out: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each bit: its place, node, the bit, and the coded pairs of each order; on request without the site's own occurrence."""
        rows = [first_slots(sites, k, self.bits) for k in range(ORDERS)]
        chance = (sites * _K1 >> np.uint64(32)).astype(np.int64) if leave_out else None
        for place, node, bit in bits_of(sites):
            slot = node_in_row(place, node)
            pairs = [self.table.take(row[place >= 4] + slot).astype(np.int64) for row in rows]
            yield place, node, bit, [without_own(x, bit, chance) for x in pairs] if leave_out else pairs

    def inputs(self, pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Mixer inputs [order and bias, site], and the longest known context of each site."""
        x = np.empty((ORDERS + 1, len(pairs[0])), np.float32)
        known = np.zeros(len(pairs[0]), np.int64)
        for k, pair in enumerate(pairs):
            x[k] = self.logits[k].take(pair)
            if k:
                np.copyto(known, k, where=pair > 0)
        x[ORDERS] = 0.3
        return x, known

    def mixed(self, x: np.ndarray, place: int, known: np.ndarray) -> np.ndarray:
        own = self.weights[:, place * ORDERS : (place + 1) * ORDERS]
        return np.clip((own.T @ x).ravel().take(known * len(known) + np.arange(len(known))), -12, 12)

    def log10(self, sites: np.ndarray) -> np.ndarray:
        """log10 probability of each site's byte, to the precision that a Memo keeps."""
        out = np.empty(len(sites), np.float32)
        for at in range(0, len(sites), CHUNK):
            part = sites[at : at + CHUNK]
            chance = np.ones(len(part))
            for place, node, bit, pairs in self.lookups(part, False):
                x, known = self.inputs(pairs)
                logit = self.mixed(x, place, known)
                # the mean of the mix and of its refinement
                p = np.clip((squash(logit) + self.refined.take(node * BUCKETS + bucket(logit))) / 2, 1e-6, 1 - 1e-6)
                chance *= np.where(bit == 1, p, 1 - p)
            out[at : at + CHUNK] = np.log10(chance)
        return out


class Memo:
    """Log-probabilities of sites that this Python process has met under one model, in a table that later sites overwrite; sites repeat from block to block."""

    def __init__(self, token: str, bits: int = 22):
        self.token, self.shift = token, np.uint64(64 - bits)
        self.sites, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)  # no site is 0: its byte would be, and so would all before

    def of(self, model: Model, sites: np.ndarray) -> np.ndarray:
        """The log10 probabilities of sites."""
        at = (sites * _K3 >> self.shift).astype(np.int64)
        out = self.values.take(at)
        unknown = np.flatnonzero((self.sites.take(at) != sites) | (sites == 0))
        if len(unknown):
            every, place = placed(sites[unknown])
            values = model.log10(every)
            out[unknown] = values[place]
            where = (every * _K3 >> self.shift).astype(np.int64)
            self.sites[where], self.values[where] = every, values  # of sites that share a place the last one stays, in both
        return out


_MEMO: list[Memo] = []


def memo_of(token: str) -> Memo:
    """The memo of one model in this process; another model's is dropped."""
    if not _MEMO or _MEMO[0].token != token:
        _MEMO[:] = [Memo(token)]
    return _MEMO[0]


def bucket(logit: np.ndarray) -> np.ndarray:
    return np.clip(((logit + 12) * (BUCKETS / 24)).astype(np.int64), 0, BUCKETS - 1)


def untrained(bits: int, table: np.ndarray) -> Model:
    middle = squash((np.arange(BUCKETS) + 0.5) * 24 / BUCKETS - 12)
    return Model(bits, table, np.zeros((ORDERS, 256), np.float32), np.full((ORDERS + 1, GATES), 0.3, np.float32), np.tile(middle, 256).astype(np.float32))


Counted = tuple[np.ndarray, np.ndarray]  # distinct sites, and how often each occurs


def merged(parts: list[Counted], most: int = 1 << 18) -> Counted:
    """The sums of several counts, each with its sites sorted; ranges of about `most` sites are added at a time, so that little is copied."""
    if len(parts) == 1:
        return parts[0]
    size, largest = sum(len(x) for x, _ in parts), max((x for x, _ in parts), key=len)
    ranges = -(-size // most)
    bounds = largest[np.arange(1, ranges) * len(largest) // ranges]
    cuts = [np.r_[0, np.searchsorted(x, bounds), len(x)] for x, _ in parts]
    every, total, at = np.empty(size, np.uint64), np.empty(size, np.int64), 0
    for k in range(ranges):
        own = [(x[c[k] : c[k + 1]], n[c[k] : c[k + 1]]) for (x, n), c in zip(parts, cuts, strict=True)]
        sites, n = distinct(np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own]))
        every[at : at + len(sites)], total[at : at + len(sites)] = sites, n
        at += len(sites)
    return every[:at], total[:at]


def counted_sites(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, size, sites, n) over all texts: a row for each shard, with its distinct sites, sorted, and how often each occurs (64-bit integers).

    Tasks count first and send a packed row for each partition, so the exchange carries few rows; a partition merges what it gets bit by bit.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shard_of(every: np.ndarray) -> np.ndarray:
        return (((every * _K3) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)

    def dealt(key: np.ndarray, every: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of sites with an equal key, each run sorted."""
        order = np.argsort(key.astype(np.uint16) if shards <= 1 << 16 and parts <= 1 << 16 else key, kind="stable")
        key, every, total = key[order], every[order], total[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for at, end in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            yield int(key[at]), every[at:end], total[at:end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counted] = []

        def send() -> Iterator[pa.RecordBatch]:
            every, total = merged(held)
            held.clear()
            for at in range(0, len(every), SENT):
                sites, n = every[at : at + SENT], total[at : at + SENT]
                rows = [(k, x.tobytes(), n.tobytes()) for k, x, n in dealt(shard_of(sites) % parts, sites, n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], names=["bucket", "sites", "n"])

        for batch in batches:
            for _, part in text_blocks(batch.column(0)):
                for group in stretches(part):
                    held.append(distinct(sites_of(group)[0]))
                    if sum(len(x) for x, _ in held) > 3_000_000:
                        held[:] = [merged(held)]
                        if len(held[0][0]) > 2_000_000:
                            yield from send()
        if held:
            yield from send()
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[Counted] = []
        for batch in batches:
            for sites, n in zip(batch.column(1), batch.column(2), strict=True):
                whole.append((np.frombuffer(sites.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)))
                if sum(len(x) for x, _ in whole[1:]) > max(1_000_000, len(whole[0][0])):
                    whole[:] = [merged(whole)]
        if whole:
            every, total = merged(whole)
            for shard, sites, n in dealt(shard_of(every), every, total):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([len(sites)], pa.int64()), pa.array([sites.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["shard", "size", "sites", "n"]
                )
        whole.clear()
        trim()

    sent = texts.mapInArrow(run, "bucket int, sites binary, n binary").repartition(parts, "bucket")
    return sent.mapInArrow(merge, "shard int, size long, sites binary, n binary")


def shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Counted]:
    """The shards of a task, one after the other."""
    for batch in batches:
        for sites, n in zip(batch.column("sites"), batch.column("n"), strict=True):
            yield np.frombuffer(sites.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)


BLOCK = 1 << 16
SPAN = 1 << 22
_PACKED = "block int, part int, packed binary"


def _pack(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes, those over 254 apart."""
    flat = counts.ravel()
    large = np.flatnonzero(flat > 254)
    low = np.minimum(flat, 255).astype(np.uint8).tobytes()
    return len(large).to_bytes(4, "little") + large.astype("<i4").tobytes() + flat[large].astype("<i8").tobytes() + pa.compress(low, "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    low = pa.decompress(packed[4 + 12 * n :], 2 * BLOCK, "zstd", asbytes=True)
    flat = np.frombuffer(low, np.uint8).astype(np.int64)
    flat[np.frombuffer(packed, "<i4", n, 4)] = np.frombuffer(packed, "<i8", n, 4 + 4 * n)
    return flat.reshape(-1, 2)


def slot_blocks(counted: DataFrame, bits: int) -> DataFrame:
    """(block, pairs): the coded pairs of each 65,536 slots, compressed.

    Counts travel as compressed blocks of a task, order by order; beyond 64 tasks the blocks of groups of tasks are added first, then the
    groups, so that no task holds more than about the root of the number of tasks.
    """
    tasks = counted.rdd.getNumPartitions()
    fan = isqrt(tasks) if tasks > 64 else 1

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % fan, []
        for shard in shards_in(batches):
            held.append(shard)
            if sum(len(x) for x, _ in held) > 1_000_000:
                yield from send(held, part)
                held = []
        if held:
            yield from send(held, part)
        trim()

    def send(held: list[tuple[np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        sites, n = np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])
        n = n.astype(np.int32 if n.sum() < 1 << 31 else np.int64)
        for order in range(ORDERS):
            top = (order - 2) << (bits + 4) if order > 1 else _HASHED << (bits + 4)
            size = (1 << (bits + 4)) if order > 1 else _DIRECT << 4
            rows = np.empty((2, len(sites)), np.int32)
            for at in range(0, len(sites), 1 << 17):
                rows[:, at : at + (1 << 17)] = first_slots(sites[at : at + (1 << 17)], order, bits)
            # a span of the table at a time: its counts are what a task holds
            for low in range(top - top % BLOCK, top + size, SPAN):
                counts = np.zeros((-(-min(top + size - low, SPAN) // BLOCK)) * BLOCK * 2, n.dtype)
                for half, row in enumerate(rows):
                    own = np.flatnonzero((row >= low) & (row < low + SPAN))
                    for at in range(0, len(own), 1 << 17):
                        some = own[at : at + (1 << 17)]
                        first, weight = row[some].astype(np.int64) - low, n[some]
                        for place, node, bit in bits_of(sites[some], range(4 * half, 4 * half + 4)):
                            np.add.at(counts, (first + node_in_row(place, node)) * 2 + bit, weight)
                parts = counts.reshape(-1, 2 * BLOCK)
                for k in np.flatnonzero(parts.any(axis=1)):
                    yield pa.RecordBatch.from_arrays([pa.array([low // BLOCK + k], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(parts[k])], pa.binary())], names=["block", "part", "packed"])

    def added(rows: pd.DataFrame) -> np.ndarray:
        total = np.zeros((BLOCK, 2), np.int64)
        for packed in rows["packed"]:
            total += _unpack(packed)
        return total

    def halfway(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "part": [0], "packed": [_pack(added(rows))]})

    def assemble(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "pairs": [pa.compress(coded_pairs(added(rows)).tobytes(), "zstd", asbytes=True)]})

    sent = counted.mapInArrow(expand, _PACKED)
    if fan > 1:
        sent = sent.groupBy("block", "part").applyInPandas(halfway, _PACKED)
    return sent.groupBy("block").applyInPandas(assemble, "block int, pairs binary")


def learnt_from(base: Model, sites: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One online pass over a shard: weights, how much each gate was used, and the final map's ones and totals."""
    own = Model(base.bits, base.table, base.logits, base.weights.copy(), base.refined)
    maps = 256 * BUCKETS
    seen, ones, total = np.zeros(GATES), np.zeros(maps), np.zeros(maps)
    for first in range(0, len(sites), CHUNK):
        some, weight = sites[first : first + CHUNK], n[first : first + CHUNK].astype(np.float32)
        for place, node, bit, pairs in own.lookups(some, True):
            x, known = own.inputs(pairs)
            gate = (known[:, None] == np.arange(ORDERS)).astype(np.float32)
            energy = weight * (1 + (x * x).sum(axis=0))
            weights = own.weights[:, place * ORDERS : (place + 1) * ORDERS]
            for turn in range(3):
                for at in range(0, len(some), STEP):
                    part = slice(at, at + STEP)
                    error = (bit[part] - squash(own.mixed(x[:, part], place, known[part]))) * weight[part]
                    # normalised steps: a gate's step shrinks with the energy of its inputs
                    weights += RATE / (1 + turn) * ((x[:, part] * error) @ gate[part]) / np.maximum(energy[part] @ gate[part], 1e-9)
            where = node * BUCKETS + bucket(own.mixed(x, place, known))
            ones += np.bincount(where, weight * bit, maps)
            total += np.bincount(where, weight, maps)
            seen[place * ORDERS : (place + 1) * ORDERS] += weight.astype(float) @ gate
    return own.weights, seen, ones, total


#: Weights travel as whole multiples of this.
FINE = 2.0**-24


def fit(texts: DataFrame, shards: int = 1) -> tuple[Model, Broadcast]:
    """Train on a DataFrame with one column of texts: the model, and the broadcast of its tables (without maps and weights, see `with_maps`).

    What reaches the driver is the model (85 MB at most). Tables are sent once; the maps and weights, some kilobytes, travel with the tasks.
    """
    spark = texts.sparkSession
    counted = materialise(counted_sites(texts, shards), "sites")
    sites = counted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    bits = max(8, min(MOST_BITS, int(sites).bit_length()))
    table = np.zeros(-(-slots(bits) // BLOCK) * BLOCK, np.uint8)
    for row in slot_blocks(counted, bits).collect():
        table[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(pa.decompress(row.pairs, BLOCK, "zstd", asbytes=True), np.uint8)
    model = untrained(bits, table)
    tables = spark.sparkContext.broadcast(untrained(bits, table))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, hits = tables.value, np.zeros(ORDERS * 512)
        for whole, counts in shards_in(batches):
            for at in range(0, len(whole), CHUNK):
                n = counts[at : at + CHUNK].astype(float)
                for _, _, bit, pairs in base.lookups(whole[at : at + CHUNK], True):
                    for k in range(ORDERS):
                        hits[k * 512 : (k + 1) * 512] += np.bincount(pairs[k] * 2 + bit, n, 512)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hits))), pa.array(hits.astype(np.int64))], names=["k", "v"])

    def summed(run, size: int) -> np.ndarray:
        """Sums over tasks of vectors of a fixed size."""
        out = np.zeros(size)
        for r in counted.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out

    zeros, ones = summed(calibrate, ORDERS * 512).reshape(ORDERS, 256, 2).transpose(2, 0, 1)
    model.logits = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -9, 9).astype(np.float32)
    start = model.maps()
    width, maps = GATES * (ORDERS + 1), 256 * BUCKETS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, values = tables.value.with_maps(start), np.zeros(width + GATES + 2 * maps)
        for sites, n in shards_in(batches):
            weights, seen, ones, total = learnt_from(base, sites, n)
            values += np.concatenate([np.round(weights * seen / FINE).ravel(), np.round(seen), np.round(ones), np.round(total)])
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values.astype(np.int64))], names=["k", "v"])

    sums, seen, ones, total = np.split(summed(learn, width + GATES + 2 * maps), [width, width + GATES, width + GATES + maps])
    learnt = seen > 0
    model.weights[:, learnt] = (sums.reshape(ORDERS + 1, GATES) * FINE / np.maximum(seen, 1))[:, learnt]
    prior = untrained(bits, table[:0]).refined
    model.refined = ((ones + 20 * prior) / (total + 20)).astype(np.float32)
    return model, tables


def counted_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        ends = 0
        for batch in batches:
            for _, part in text_blocks(batch.column(0)):
                ends += len(part)
                for group in stretches(part):
                    coded, _ = words_in(group)
                    held.append(pa.table({"word": coded.dictionary, "c": np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))}))
                    if sum(x.num_rows for x in held) > 1_000_000:
                        held[:] = [merged()]
                        if held[0].num_rows > 500_000:
                            yield from held.pop().to_batches()
        held.append(pa.table({"word": pa.array([b""] if ends else [], pa.binary()), "c": pa.array([ends] if ends else [], pa.int64())}))
        yield from merged().to_batches()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def held_out(id_col: str, folds: int = 10):
    """Whether a row belongs to the fold that isn't learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def scored_block(memo: Memo, model: Model, known: pa.Array, logs: np.ndarray, texts: list[str]) -> dict[str, np.ndarray | pa.Array]:
    """Scores of texts: by the model, by the frequent words, and each text's other words with how often they occur."""
    count = len(texts)
    score, often_sum = np.zeros(count), np.zeros(count)
    size, tokens, often = np.zeros(count, np.int64), np.ones(count, np.int64), np.zeros(count, np.int64)
    end = pc.index_in(pa.array([b""], pa.binary()), value_set=known)[0].as_py()
    if end is not None:
        often_sum += logs[end]
        often += 1
    found_words: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    for group in stretches(texts):
        of = np.array([k for k, *_ in group])
        found, starts = sites_of(group)
        lengths = np.diff(np.r_[starts, len(found)])
        np.add.at(size, of, lengths - np.array([last for *_, last in group]))
        # sums of one stretch after the other, as the texts run
        np.add.at(score, of, np.add.reduceat(memo.of(model, found), starts, dtype=float))
        coded, stretch = words_in(group)
        found_words.append((of[stretch], coded.indices.to_numpy(), coded.dictionary))
    places = pc.index_in(pa.concat_arrays([x for _, _, x in found_words]), value_set=known).fill_null(-1).to_numpy() if found_words else np.zeros(0, np.int64)
    rare: list[tuple[np.ndarray, pa.Array]] = []
    for text, word, dictionary in found_words:
        place, places = places[: len(dictionary)], places[len(dictionary) :]
        tokens += np.bincount(text, minlength=count)
        hit = place[word] >= 0
        often += np.bincount(text[hit], minlength=count)
        often_sum += np.bincount(text[hit], logs[place[word[hit]]], count)
        rare.append((text[~hit], dictionary.take(pa.array(word[~hit]))))
    owner = np.concatenate([x for x, _ in rare]) if rare else np.zeros(0, np.int64)
    coded = pa.concat_arrays([x for _, x in rare]).dictionary_encode() if rare else pa.array([], pa.binary()).dictionary_encode()
    many = max(len(coded.dictionary), 1)
    keys, times = np.unique(owner * many + coded.indices.to_numpy(), return_counts=True)
    offsets = np.searchsorted(keys, np.arange(count + 1) * many).astype(np.int32)
    words = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(keys % many)), pa.array(times.astype(np.int64))], ["word", "m"])
    return {"n_tokens": tokens, "n_often": often, "often_sum": often_sum, "score": score, "n_bytes": size, "rare": pa.ListArray.from_arrays(pa.array(offsets), words)}


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Fit on the rows outside the fold, score all.

    id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col), held_out(id_col, folds).alias("held_out"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_hz_t"))
    training = rows.filter(~F.col("held_out")).select("_hz_t")
    words = materialise(counted_words(training), "words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals.n, totals.v
    often = ((F.col("c") * FREQUENT > n) & (F.octet_length("word") <= 64)) | (F.octet_length("word") == 0)  # at most FREQUENT words
    frequent = words.filter(often).toArrow()
    lower = 0.1 * (v + 1)
    known = frequent["word"].combine_chunks() if frequent.num_rows else pa.array([], pa.binary())
    logs = np.log10((frequent["c"].to_numpy().astype(float) + 0.1) / (n + lower))
    model, tables = fit(training, max(1, n // SHARD_TOKENS))
    maps, sent = model.maps(), spark.sparkContext.broadcast((known.cast(pa.binary()), logs))
    kind, token = rows.schema[id_col].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_id, model = TaskContext.get().partitionId() << 40, tables.value.with_maps(maps)
        for batch in batches:
            for at, texts in text_blocks(batch.column(2)):
                found = scored_block(memo_of(token), model, *sent.value, texts)
                number = np.arange(row_id, row_id + len(texts))
                row_id += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(number), *[pa.array(x) if isinstance(x, np.ndarray) else x for x in found.values()]],
                    names=[id_col, "held_out", "_hz_row", *found],
                )
        trim()

    schema = (
        f"`{id_col}` {kind}, held_out boolean, _hz_row long, n_tokens long, n_often long, often_sum double, score double, n_bytes long, "
        "rare array<struct<word: binary, m: bigint>>"
    )
    scored = materialise(rows.mapInArrow(run, schema), "scored")
    tables.destroy()
    sent.destroy()
    rare = scored.select("_hz_row", F.explode("rare").alias("r")).select("_hz_row", "r.word", "r.m")
    met = rare.join(words.filter(~often), "word", "left")
    each = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(float(n + lower)))
    sums = met.groupBy("_hz_row").agg(F.sum(F.col("m") * each).alias("rare_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("m"))).alias("rare_known"))
    base_score = F.col("often_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return scored.drop("rare").join(sums, "_hz_row", "left").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_often") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
