"""Chat formatting by schema fingerprints.

A record is JSON. Its fingerprint is a hash of its sorted nested field paths (array elements as ``[]``), without values; fields that
are null count as absent. A registry maps fingerprints to declarative mappings, which say where roles and texts
stand; so records of many layouts become canonical turns (id, turn, role, text) without any guess about their contents.

A turn is then formatted by itself, as ``<|turn|>role``, a line end, the text and ``<|end|>`` with a line end. Inside roles and texts a
backslash is doubled, and one is put after the first character of every control string; in a role also before a line end. Reading removes
a backslash and keeps what follows. A conversation is its turns' segments one after the other; it is read back as one stream of
characters, which knows nothing of rows (Reader), so nothing gathers a conversation in memory: digests are taken while sorted rows stream by.

Defined results: ids are whole numbers. A null text or role is empty, a null turn number is 0. Turns that share a number are ordered by role, then text;
repeated rows are turns of their own. A record of unknown layout
gives one row without turn, with its fingerprint in ``unmapped``; a conversation of only such records has no formatted text, and no row of digests. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that must not stand in a formatted text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
_CONTROL = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    Either ``each``: the path of an array, with the role's and the text's field in its elements; or ``fixed``: (role, fields joined by a
    line end) in order; or ``flat``: the record is one turn (fields of number, role and text).
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    flat: tuple[str, str, str] | None = None


MAPPINGS = (
    Mapping("turn rows", (), ("conv_id", "turn", "role", "text"), flat=("turn", "role", "text")),
    Mapping("messages", ("messages[].role",), ("messages[].content", "id", "conv_id"), each=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from",), ("conversations[].value", "id", "conv_id"), each=("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id", "conv_id"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt and completion", ("prompt", "completion"), ("system", "id", "conv_id"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt", "response"), ("system", "id", "conv_id"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", ("question", "answer"), ("context", "id", "conv_id"), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def paths_of(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if v is not None for p in paths_of(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    """Hash of a set of paths."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    """Every fingerprint that a mapping accepts: the required paths with any of the optional ones."""
    found: dict[str, Mapping] = {}
    for mapping in mappings:
        for size in range(len(mapping.optional) + 1):
            for more in combinations(mapping.optional, size):
                found.setdefault(fingerprint({*mapping.required, *more}), mapping)
    return found


def turns_of(record: dict, mapping: Mapping) -> list[tuple[int, str, str]]:
    """(number, role, text) of a record."""
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    role = lambda x: ROLES.get(text(x), text(x))
    if mapping.flat:
        number, who, what = mapping.flat
        return [(int(record.get(number) or 0), text(record.get(who)), text(record.get(what)))]
    if mapping.each:
        array, who, what = mapping.each
        return [(k, role(x.get(who)), text(x.get(what))) for k, x in enumerate(record[array])]
    parts = [(who, [text(record[f]) for f in fields if record.get(f) not in (None, "")]) for who, fields in mapping.fixed]
    return [(k, who, "\n".join(found)) for k, (who, found) in enumerate(x for x in parts if x[1] or x[0] != "system")]


def canonical_turns(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """(id, turn, role, text, layout, unmapped) of JSON records."""
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        for batch in batches:
            out = []
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text or "")
                except ValueError:
                    record = None
                mark = fingerprint(paths_of(record)) if isinstance(record, dict) else "not an object"
                if (mapping := known.get(mark)) is None:
                    out.append((owner, None, None, None, None, mark))
                else:
                    out += [(owner, *turn, mapping.name, None) for turn in turns_of(record, mapping)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["id", "turn", "role", "text", "layout", "unmapped"])

    return rows.mapInArrow(run, "id long, turn long, role string, text string, layout string, unmapped string")


def escape(text):
    """Column: no control string left, reversible."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def escape_role(role):
    """Column: as escape(), and a line end is marked."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def format_turns(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, turn, role, segment, loss_from, loss_to): each turn's formatted segment, and which of its characters are learnt."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    parts = turns.filter("turn IS NOT NULL").select("id", "turn", F.coalesce("role", F.lit("")).alias("role"), role.alias("_hz_r"), text.alias("_hz_t"))
    start = F.length("_hz_r") + F.lit(len(OPEN) + 1)
    learnt = F.col("role").isin(*learn_from)
    return parts.select(
        "id", "turn", "role", F.concat(F.lit(OPEN), "_hz_r", F.lit("\n"), "_hz_t", F.lit(CLOSE)).alias("segment"),
        F.when(learnt, start).otherwise(F.lit(0)).alias("loss_from"),
        F.when(learnt, start + F.length("_hz_t")).otherwise(F.lit(0)).alias("loss_to"),
    )


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


_ROLE_END = re.compile(r"(?s)((?:[^\\\n]|\\.)*)\n")


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a turn")
    head = _ROLE_END.match(segment, len(OPEN))
    if head is None or head.end() > len(segment) - len(CLOSE):
        raise ValueError("a turn without a role")
    return unescape(head[1]), unescape(segment[head.end() : -len(CLOSE)])


class Reader:
    """Reads formatted conversations back from any pieces of their characters."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that the piece completes. No text holds CLOSE, so the first one ends a turn."""
        tail = "".join(self.waiting)[-len(CLOSE) :] if self.waiting else ""
        self.waiting.append(piece)
        if CLOSE not in tail + piece:
            return
        whole = "".join(self.waiting)
        *turns, rest = whole.split(CLOSE)
        self.waiting = [rest] if rest else []
        for turn in turns:
            yield read_segment(turn + CLOSE)

    def close(self) -> None:
        """Raises ValueError if a turn has not ended."""
        if self.waiting:
            raise ValueError("the conversation breaks off")


def read_conversation(text: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    reader = Reader()
    found = list(reader.feed(text))
    reader.close()
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the segments: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ordered = formatted.repartition("id").sortWithinPartitions("id", "turn", "role", "segment")
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        done: list[tuple] = []
        reader = Reader()

        def close() -> None:
            reader.close()
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("id", "segment", "loss_from", "loss_to")]
            for owner, segment, start, end in zip(*columns, strict=True):
                if not now or now[0] != owner:
                    if now:
                        close()
                    now = [owner, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in reader.feed(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learnt = unescape(segment[start:end])
                now[3] += len(learnt)
                now[4].update(learnt.encode("utf-8", "surrogatepass"))
                now[5] += len(segment)
            if len(done) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if now:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
