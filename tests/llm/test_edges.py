"""Nulls, empty and repeated rows, ties, empty tables and columns with clashing names, for every operator and every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

from hazardry.llm import bpe, chat, common, exact, lines, mixing, near, packing, quality, urls, warc

tokenizers_ = pytest.importorskip("public_tokenizers")
BYTES, PATTERN, WORDS = tokenizers_.path("byte_bpe_50k.tiktoken"), tokenizers_.PATTERN, tokenizers_.path("word_bpe_49k.json")
LONG = "some words of a very long text " * 4000

OPERATORS = {
    "mixing": lambda df: mixing.score(df),
    "bpe": lambda df: bpe.round_trip(df, BYTES, PATTERN),
    "bpe in two steps": lambda df: bpe.decode(bpe.encode(df, BYTES, PATTERN), BYTES, PATTERN),
    "near": lambda df: near.near_groups(df),
    "exact": lambda df: exact.exact_groups(df),
    "lines": lambda df: lines.dedup_lines(df, enough=2),
    "quality": lambda df: quality.ledger(df),
    "urls": lambda df: urls.judge(df, [("block", "com/")], urls.model(), id_col="doc_id", url_col="text"),
    "warc": lambda df: warc.round_trip(df, id_col="doc_id", uri_col="source", payload_col="text"),
}
#: Columns that operators make themselves, or use inside.
CLASHING = ("id key n a b c bucket rep component kept class_id word site m start length part nth offset sequence_id doc_tokens ids decoded recipe d target refers_to payload uri archive "
            "h1 h2 pos host path verdict rule probability score held_out rare n_words fail_bits _hz_row _hz_t _hz_id _hz_k").split()  # fmt: skip


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


ROWS = [(1, "Alpha beta, gamma.\n\nx"), (1, "Alpha beta, gamma.\n\nx"), (2, None), (3, ""), (None, "no id"), (None, None), (4, " \t\n"), (5, LONG), (6, LONG + "end"), (7, "Alpha beta, gamma.\n\nx")]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_rows_and_clashing_columns(spark, name):
    df = _docs(spark, ROWS)
    plain = OPERATORS[name](df)
    wide = OPERATORS[name](df.withColumns({c: F.lit("other") for c in CLASHING}).repartition(3))
    assert wide.columns == plain.columns
    drop = [c for c in ("archive", "offset", "score", "bits_per_byte", "base_score", "probability") if c in plain.columns]
    assert sorted(map(str, plain.drop(*drop).collect())) == sorted(map(str, wide.drop(*drop).collect()))
    assert plain.count() == len(ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_tables(spark, name):
    df = _docs(spark, ROWS)
    assert OPERATORS[name](df.limit(0)).count() == 0
    assert OPERATORS[name](df.filter("text IS NULL")).count() == 2


def test_packing_of_the_same_rows(spark):
    df = _docs(spark, ROWS)
    for rows in (packing.pack(df, WORDS), packing.pack(df.withColumns({c: F.lit("other") for c in CLASHING}), WORDS)):
        got = rows.collect()
        assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert sum(r.length for r in got if r.doc_id == 2) == 1 and len([r for r in got if r.doc_id == 1]) == 2
        assert sum(r.length for r in got) == sum({r.ids_crc32: 0 for r in got}.values()) + sum(r.doc_tokens for r in got if r.start == 0)
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_chat_records_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, '{"prompt": "q", "completion": "a"}', "x", "y")] * 2 + [(None, None, "x", "y")], "conv_id long, record string, turn string, unmapped string")
    turns = chat.canonical_turns(rows)
    assert turns.filter("id = 1").count() == 4 and turns.filter("unmapped IS NOT NULL").count() == 1
    assert [r.n_turns for r in chat.digests(chat.format_turns(turns)).collect()] == [4]
    assert chat.digests(chat.format_turns(chat.canonical_turns(rows.limit(0)))).count() == 0


def _words(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    near_copy = _words(3).replace("w3x39", "other")
    rows = [(1, _words(1)), (1, _words(1)), (2, _words(1).upper()), (3, _words(3)), (4, near_copy), (5, None), (6, ""), (None, _words(7)), (None, _words(7)), (8, _words(8)), (8, _words(9)), (10, LONG)]
    docs = _docs(spark, rows).withColumn("_hz_k", F.lit("own")).withColumn("kept", F.lit(None).cast("string"))
    want = {
        "quality": [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (None, 7), (None, 7), (8, 8), (8, 9)],
        "exact": [(2, 1), (3, 3), (4, 4), (None, 7), (8, 8), (8, 9)],
        "near": [(2, 1), (3, 3), (None, 7), (8, 8)],
    }
    marks = {_words(k).lower(): k for k in (1, 3, 7, 8, 9)} | {near_copy: 4}
    order = lambda x: (x[0] is None, x)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(((r.doc_id, marks[r.text.lower()]) for r in docs.collect()), key=order) == sorted(want[name], key=order), name
        assert {(r._hz_k, r.kept) for r in docs.collect()} == {("own", None)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == 4 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_scratch_is_deleted(spark):
    with common.scratch(spark):
        rows = exact.exact_groups(_docs(spark, ROWS)).collect()
        written = list(common._SCRATCH[-1])
    assert len(rows) == len(ROWS) and written
    for path in written:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
