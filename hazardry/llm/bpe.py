"""Byte-level BPE encoding and decoding with recursive SQL in each task.

Texts are split by the vocabulary's pattern, each distinct piece is encoded once. A piece is a set of rows (word, position,
token, next position, next token). A step of the recursion joins them with the merge table (every pair of tokens whose
bytes together are a token, with that token as rank), finds each word's leftmost pair of minimum rank, and contracts it;
words without such a pair are done and leave the recursion. Rows carry their successor, so a step is hash joins and one hash
aggregation, without a sort. Decoding joins all tokens of a block of texts with the vocabulary, in their order; texts are cut from the bytes by their numbers of tokens.

The recursion runs in rounds of ROUND steps, since it keeps all its steps: words that are not done after a round start the next one. Its time grows with the
square of a word's length all the same (0.3 s of a slow core for 1,024 bytes, 2.1 s for 4,096, 5.4 s for 8,192; the heap takes 0.02, 0.07 and 0.3 s), so one piece of
a megabyte would hold a task for days; pieces over LONG_PIECE bytes are therefore contracted by a heap with the same rule.

A reused Python worker keeps its database and a bounded cache of pieces. Nothing is shuffled.

Defined results: a null or empty text has no tokens. Repeated rows get a row each. An empty table gives an
empty result. Strings of special tokens are ordinary text. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import TwoGenerations, blocks

LONG_PIECE = 4096
ROUND = 64
STEP_BYTES = 250_000
BLOCK = 1_000_000

CONTRACT = """
WITH RECURSIVE state(w, p, t, q, u, done, step) AS (
  SELECT w, p, t, q, u, false, 0 FROM start
  UNION ALL
  (
    WITH best AS (
      SELECT s.w, min((m.id::BIGINT << 32) + s.p) AS b FROM state s JOIN merges m ON m.l = s.t AND m.r = s.u WHERE NOT s.done GROUP BY s.w
    ),
    pick AS (
      SELECT b.w, x.p AS p0, x.q AS q0, (b.b >> 32)::INTEGER AS id FROM best b JOIN state x ON x.w = b.w AND x.p = (b.b & 4294967295)
    ),
    link AS (SELECT k.*, y.q AS q1, y.u AS u1 FROM pick k JOIN state y ON y.w = k.w AND y.p = k.q0)
    SELECT s.w, s.p,
           CASE WHEN s.p = k.p0 THEN k.id ELSE s.t END,
           CASE WHEN s.p = k.p0 THEN k.q1 ELSE s.q END,
           CASE WHEN s.p = k.p0 THEN k.u1 WHEN s.q = k.p0 THEN k.id ELSE s.u END,
           k.w IS NULL, s.step + 1
    FROM state s LEFT JOIN link k ON k.w = s.w
    WHERE NOT s.done AND s.step < %d AND (k.w IS NULL OR s.p <> k.q0)
  )
)
SELECT w, p, t, q, u, done FROM state WHERE done OR step = %d
"""

DECODE = """
SELECT coalesce(v.b, ''::BLOB) AS b FROM ids i LEFT JOIN vocabulary v ON v.id = i.t ORDER BY i.p
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary in one Python process."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '300MB'")
        self.db.execute("SET temp_directory = ''")
        pairs = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        # for the heap: (left << 20 | right) of each pair in order, and its rank
        keys = np.array([left << 20 | right for left, right, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([rank for *_, rank in pairs], np.int64)[order]
        columns = [pa.array(column, pa.int32()) for column in zip(*pairs, strict=True)] if pairs else [pa.array([], pa.int32())] * 3
        self._table("merges", pa.table(columns, names=["l", "r", "id"]))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "b": pa.array(list(self.ranks), pa.binary())}))
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.pieces = TwoGenerations(self.encode_pieces, 300_000)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        waiting: list[tuple[int, bytes]] = []
        size = 0
        for k, piece in enumerate(pieces):
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                out[k] = self.contract_long(raw)
            else:
                waiting.append((k, raw))
                size += len(raw)
                if size >= STEP_BYTES:
                    self._contract(waiting, out)
                    waiting, size = [], 0
        self._contract(waiting, out)
        return out

    def _contract(self, waiting: list[tuple[int, bytes]], out: list[bytes | None]) -> None:
        if not waiting:
            return
        lengths = np.array([len(raw) for _, raw in waiting])
        tokens = self.single[np.frombuffer(b"".join(raw for _, raw in waiting), np.uint8)]
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(waiting), dtype=np.int32), lengths)
        place = (np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)).astype(np.int64)
        last = np.zeros(len(tokens), bool)
        last[ends - 1] = True
        after = np.r_[tokens[1:], 0]
        start = pa.table(
            {"w": word, "p": place, "t": tokens, "q": pa.array(place + 1, mask=last), "u": pa.array(after.astype(np.int32), mask=last)}
        )
        parts = []
        while len(start):
            self._table("start", start)
            found = self.db.sql(CONTRACT % (ROUND, ROUND)).to_arrow_table()
            parts.append(found.filter(found["done"]).select(["w", "p", "t"]))
            start = found.filter(pc.invert(found["done"])).drop_columns(["done"])
        done = pa.concat_tables(parts).sort_by([("w", "ascending"), ("p", "ascending")])
        ids = done["t"].to_numpy().astype("<u4")
        cut = np.searchsorted(done["w"].to_numpy(), np.arange(len(waiting) + 1))
        for n, (k, _) in enumerate(waiting):
            out[k] = ids[cut[n] : cut[n + 1]].tobytes()

    def rank_of(self, left: int, right: int) -> int | None:
        """The rank of a pair of tokens, if its bytes are a token."""
        key = left << 20 | right
        at = int(np.searchsorted(self.pair_keys, key))
        return int(self.pair_ranks[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else None

    def contract_long(self, raw: bytes) -> bytes:
        """The same contraction for one long piece: leftmost minimum-rank pair first, from a heap."""
        token = [int(self.single[x]) for x in raw]
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < len(token) and (rank := self.rank_of(token[k], token[after[k]])) is not None:
                heapq.heappush(heap, (rank, k, token[k], token[after[k]]))

        for k in range(len(token)):
            push(k)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            if token[k] != left or after[k] >= len(token) or token[after[k]] != right:
                continue
            gone = after[k]
            token[k], token[gone], after[k] = rank, -1, after[gone]
            if after[k] < len(token):
                before[after[k]] = k
            push(before[k])
            push(k)
        return np.array([x for x in token if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        split = [self.pattern.findall(text) for text in texts]
        get = self.pieces.of({piece for row in split for piece in row}).__getitem__
        return [b"".join(map(get, row)) for row in split]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        tokens = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
        if not len(tokens):
            return [b""] * len(rows)
        self.db.register("ids", pa.table({"p": np.arange(len(tokens)), "t": tokens}))
        found = self.db.sql(DECODE).to_arrow_table()["b"].combine_chunks()
        self.db.unregister("ids")
        offsets = np.frombuffer(found.buffers()[1], np.int32, len(tokens) + 1, 4 * found.offset)
        cuts = offsets[np.r_[0, np.cumsum([len(row) // 4 for row in rows])]].tolist()
        raw = memoryview(found.buffers()[2] or b"")
        return [bytes(raw[at:end]) for at, end in zip(cuts[:-1], cuts[1:], strict=True)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    """The codec of this Python process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_hz_t"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            for at, texts in blocks(batch.column(1).to_pylist(), BLOCK):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[id_col, "n_tokens", "ids"],
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows of encode() with ``decoded``, the bytes that the ids stand for."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    place, names = df.columns.index(ids_col), [*df.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            for at, rows in blocks(batch.column(place).to_pylist(), 2 * BLOCK):
                part = batch.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(rows), pa.binary())], names=names)

    return df.mapInArrow(run, f"{fields}, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one Python worker: id, n_tokens, ids, decoded."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_hz_t"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            for at, texts in blocks(batch.column(1).to_pylist(), BLOCK):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(codec.decode(ids), pa.binary())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
