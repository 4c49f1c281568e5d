"""Quality ledger, line dedup and exact dedup against brute force, with nulls, empty and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from hazardry.llm import exact, lines, quality
from hazardry.llm.common import LOWER, UPPER

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(UPPER, LOWER)
SPACE = " \t\n\x0b\x0c\r"


def _docs(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept string, keep_id string")


def _texts():
    rng = random.Random(5)
    pool = ["alpha", "Beta", "gamma", "é", "日本", "#x", "a$b", "tail|"]
    out = [None, "", "\n", "   ", "one", "\x0b\x0c tab\there\r\n", "same same same same same same", "A\na\nA \n b"]
    for _ in range(60):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(1, 60)))
        out.append(text if rng.random() < 0.7 else text + text)
    return out + out[10:14] + ["word " * 30000, "x" * 20000]


def _measures(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(5)}
    some = [x for x in text.split("\n") if x.strip(SPACE)]
    echo = sum(a == b for a, b in zip(w, w[1:]))
    return (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(some), len(some) - len(set(some)), len(covered), echo)


def test_ledger(spark):
    texts = _texts()
    got = {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in quality.ledger(_docs(spark, texts)).collect()}
    assert got == {k: _measures(t) for k, t in enumerate(texts)}


def test_policies_and_ablation(spark):
    rows = quality.ledger(_docs(spark, _texts())).cache()
    judged = quality.apply_policy(rows, quality.STANDARD).collect()
    assert all(r.kept == (r.fail_bits & quality.STANDARD.mask == 0) and r.policy == "1" for r in judged)
    table = {r.rule: r for r in quality.ablation(rows, quality.STANDARD).collect()}
    for name in quality.STANDARD.rules:
        bit = quality.bit(name)
        assert (table[name].n_failed if name in table else 0) == sum(bool(r.fail_bits & bit) for r in judged)
        assert (table[name].n_only if name in table else 0) == sum(r.fail_bits & quality.STANDARD.mask == bit for r in judged)


def test_filter_keeps_columns(spark):
    df = _docs(spark, [None, "one two three four five six seven eight nine ten eleven", "x"])
    out = quality.keep_documents(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]


@pytest.mark.parametrize("enough", [2, 10])
def test_lines(spark, enough):
    texts = [None, "", "x\ny", "X \nz", " x\n\nx", "q\r\nx"] + [f"common\nown {k}\n\tCommon" for k in range(12)]
    key = lambda line: line.strip(SPACE).translate(LOW)
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    got = {r.doc_id: r for r in lines.dedup_lines(_docs(spark, texts), enough=enough).collect()}
    for k, t in enumerate(texts):
        every = (t or "").split("\n")
        kept = [x for x in every if not seen[key(x)] >= enough]
        assert (got[k].n_lines, got[k].n_dropped, got[k].kept_text) == (len(every), len(every) - len(kept), "\n".join(kept)), t


def test_lines_of_repeated_rows_and_null_ids(spark):
    df = _docs(spark, ["a\nb"] * 3 + ["a\nc"], ids=[1, 1, None, None])
    assert sorted(r.kept_text for r in lines.dedup_lines(df, enough=4).collect()) == ["b", "b", "b", "c"]


def test_runs_compact_and_open_again(spark, tmp_path):
    rng = random.Random(3)
    total, path = Counter(), str(tmp_path / "runs")
    for number in range(7):
        batch = [(k, -k, rng.randrange(1, 3)) for k in range(40) if rng.random() < 0.6]
        settled = {k for k, n in total.items() if n >= 8}
        total.update({k: n for k, _, n in batch if k not in settled})
        store = lines.RunStore(spark, path, enough=8 if number == 0 else 99, fan_in=2)
        store.add(spark.createDataFrame(batch, "h1 long, h2 long, n long"))
        assert {r.h1: r.n for r in store.counts().collect()} == dict(total)
        assert {r.h1 for r in store.frequent().collect()} == {k for k, n in total.items() if n >= 8}
        assert sum(map(len, store.levels)) <= 3
        store.close()


def test_runs_merge_without_an_exchange(spark, tmp_path):
    store = lines.RunStore(spark, str(tmp_path / "runs"), enough=3, fan_in=9)
    for _ in range(3):
        store.add(spark.createDataFrame([(k, k, 1) for k in range(50)], "h1 long, h2 long, n long"))
    plan = store.frequent()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    store.close()


def test_a_long_document_loses_its_lines_in_linear_time(spark):
    import time

    text = "\n".join(f"line {k}" for k in range(100_000))
    df = _docs(spark, [text, text, "own"])
    start = time.monotonic()
    assert {(r.doc_id, r.n_dropped, r.kept_text) for r in lines.dedup_lines(df, enough=2).collect()} == {(0, 100_000, ""), (1, 100_000, ""), (2, 0, "own")}
    assert time.monotonic() - start < 150


def test_exact(spark):
    long = "some words here " * 4000
    texts = ["Abc", "aBC", "abc ", None, "", "É", "é", long, long.upper(), long + "x", "Abc"]
    got = {}
    for r in exact.exact_groups(_docs(spark, texts, ids=[*range(10), 0])).collect():
        got.setdefault(r.doc_id, []).append(r)
    norm = [(t or "").translate(LOW) for t in texts]
    for k, t in enumerate(norm[:10]):
        same = [i for i, x in enumerate(norm) if x == t]
        row = got[k][0]
        ids = [i if i < 10 else 0 for i in same]
        assert (row.keep_id, row.group_size, row.kept) == (max(ids), len(same), max(ids) == k)
        assert row.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(got[0]) == 2


def test_recipes_alone_decide(spark):
    """Identifiers that stand for several chunks are found out and widened; without that, the weak ones would group wrongly."""
    from pyspark.sql import functions as F

    df = _docs(spark, ["abc", "abd", "xyz", "abc", "long " * 2000, "long " * 2000])
    weak = lambda c: F.length(c).cast("long")
    assert exact.dictionary(exact.recipes(df, identify=weak)).filter(~F.col("verified")).count() >= 1
    for identify in (F.xxhash64, weak):
        assert {r.doc_id: r.keep_id for r in exact.exact_groups(df, identify=identify).collect()} == {0: 3, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5}
    blind = lambda c: F.lit(1).cast("long")
    rows = exact.recipes(df.filter("doc_id = 0"), identify=blind)
    assert [r.ids for r in rows.collect()] == [[1]]


def test_exact_filter_leaves_one_of_repeated_rows(spark):
    df = _docs(spark, ["a", "A", "a", "b", "b", None, None, "c"], ids=[3, 3, 3, 1, 2, None, None, None])
    out = exact.keep_documents(df)
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()) == [(0, ""), (0, "c"), (2, "b"), (3, "a")]


def test_chunks_are_the_text(spark):
    df = _docs(spark, [t for t in _texts() if t] + ["e " * 5000])
    from pyspark.sql import functions as F

    assert df.filter(F.array_join(exact.chunks(F.col("text")), "") != F.col("text")).count() == 0
    assert exact.dictionary(exact.recipes(df)).filter(~F.col("verified")).count() == 0


def test_exact_filter(spark):
    df = _docs(spark, ["a", "A", "b"])
    out = exact.keep_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_empty_tables(spark):
    none = _docs(spark, ["a"]).limit(0)
    assert quality.ledger(none).count() == 0 and exact.exact_groups(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_no_python_in_the_plans(spark):
    df = _docs(spark, ["a\nb", "a"])
    for out in (quality.ledger(df), exact.exact_groups(df), lines.dedup_lines(df)):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
