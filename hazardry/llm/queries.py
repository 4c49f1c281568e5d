"""Queries of the llm operators over the test tables, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hazardry.llm import bpe, chat, exact, lines, mixing, near, packing, quality, urls, warc
from hazardry.llm.common import LOWER, SPACE_CLASS, UPPER, table

Query = Callable[[SparkSession, str], DataFrame]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and standard policy over the ledger of all documents."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails(quality.BASE).alias("base_failed"),
        (~quality.fails(quality.STANDARD)).alias("kept"),
        "fail_bits",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in at least 10 documents go from all of them."""
    rows = lines.dedup_lines(table(spark, sf_dir, "documents"), enough=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context mixing and unigram scores of all documents."""
    return mixing.score(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, row by row, and one more in the layout of messages whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    said = "</s>[INST] ok [/INST]"
    more = json.dumps({"conv_id": -7, "messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    rows = rows.unionByName(spark.createDataFrame([(-7, more)], "conv_id long, record string"))
    return chat.digests(chat.format_turns(chat.canonical_turns(rows))).withColumnRenamed("id", "conv_id")


#: The rules of the query over pages.
PAGE_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), PAGE_RULES, urls.model())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages")).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return near.near_groups(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE trim(x, {_SPACES}) <> '' GROUP BY r
),
m AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
         length(translate(t, {_SPACES}, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
         coalesce(ln.n_lines, 0)::BIGINT AS n_lines,
         coalesce(ln.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echo_words
  FROM d LEFT JOIN cov ON cov.r = d.r LEFT JOIN ln ON ln.r = d.r
),
l AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(quality.RULES))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM l
"""

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
p AS (SELECT r, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM d),
k AS (SELECT r, i, line, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS key FROM p),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key),
g AS (
  SELECT r, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t
  FROM j GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM g JOIN d ON d.r = g.r
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def queries() -> dict[str, Query]:
    """The queries by name."""
    return {
        "pipeline": corpus_pipeline.run,
        "op1_lm_scoring": op1_lm_scoring,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_url_filter": op3_url_filter,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_packing": op5_packing,
        "op6_near_dedup": op6_near_dedup,
        "op7_warc": op7_warc,
        "op8_quality_rules": op8_quality_rules,
        "op9_line_dedup": op9_line_dedup,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return found | {"op8_quality_rules": OP8_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL}
