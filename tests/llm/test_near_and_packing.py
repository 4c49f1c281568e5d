"""Near-duplicates and packing against brute force; the pipeline against its brute-force version."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hazardry.llm import near, packing

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _docs(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_band(spark):
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        full = _subsequence(a, b)
        assert near.common_in_band(a, b, 20) == full
        assert near.common_in_band(a, b, rng.randrange(1, 6)) <= full


def _similar(a, b):
    x, y = ([tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for w in (near.tokens(a), near.tokens(b)))
    if not x or not y:
        return not x and not y
    n = _subsequence(x, y)
    return n / (len(x) + len(y) - n) >= 0.8 - 1e-12


def _corpus():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    out = [None, "", " ", "One two", "one TWO", "a b c d", "a b c e"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).capitalize())
    return out


def _classes(texts, ids):
    of = {i: i for i in ids}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if find(ids[a]) != find(ids[b]) and _similar(texts[a], texts[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                of[y] = x
    return {i: find(i) for i in ids}


def test_groups(spark):
    texts = _corpus()
    wanted = _classes(texts, list(range(len(texts))))
    assert {r.doc_id: r.class_id for r in near.near_groups(_docs(spark, texts)).collect()} == wanted


def test_chains_are_one_group_and_order_matters(spark):
    base = [f"w{k}" for k in range(100)]
    chain = [base[k * 2 :] + [f"n{j}" for j in range(k * 2)] for k in range(8)]
    moved = base[50:] + base[:50]
    got = {r.doc_id: r.class_id for r in near.near_groups(_docs(spark, [" ".join(x) for x in [*chain, moved]])).collect()}
    assert [got[k] for k in range(9)] == [0] * 8 + [8]


def test_pairs_that_no_leader_is_similar_to_are_linked(spark):
    core = [f"w{k}" for k in range(83)]
    tails = [[f"t{j}x{k}" for k in range(10)] for j in range(40)]
    for j in range(20, 40, 2):
        tails[j + 1][0] = tails[j][0]
    texts = [" ".join(core + tail) for tail in tails]
    wanted = _classes(texts, list(range(len(texts))))
    assert wanted == {k: k - 1 if k > 20 and k % 2 else k for k in range(40)}
    assert {r.doc_id: r.class_id for r in near.near_groups(_docs(spark, texts)).collect()} == wanted


def test_many_blocks_lose_no_link(spark, monkeypatch):
    """Squares of tiny blocks, run in this process, join what one square joins."""
    rng = random.Random(5)
    hashes = near.WordHashes()
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(copy))
    n = np.array([len(near.Shingled(t, hashes).order) for t in texts])
    ids, component, level = np.arange(40), np.arange(40), int(np.floor(np.log(n[0]) / -np.log(0.8)))
    marks = [[0] * near.SKETCHES] * 40

    def classes(blocks):
        block, links = ids % blocks, []
        for lo in range(blocks):
            for hi in range(lo, blocks):
                rows = np.flatnonzero((block == lo) | (block == hi))
                links += near.linked_in_square(ids[rows], block[rows], component[rows], n[rows], level, near.SKETCHES, lo, hi, [marks[k] for k in rows], [texts[k] for k in rows], hashes)
        of = {k: k for k in range(40)}
        for _ in of:
            for a, b in links:
                of[a] = of[b] = min(of[a], of[b])
        assert all(_similar(texts[a], texts[b]) for a, b in links)
        return of

    wanted = _classes(texts, list(range(40)))
    assert 2 < len(set(wanted.values())) < 30
    for blocks in (1, 3, 7):
        assert classes(blocks) == wanted


def test_short_texts_share_a_smallest_shingle():
    rng = random.Random(11)
    hashes = near.WordHashes()
    met = 0
    for _ in range(3000):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(8, 34))]
        b = list(a)
        for _ in range(rng.randrange(1, 3)):
            at = rng.choice((0, len(b) - 1, rng.randrange(len(b))))
            b = b[:at] + b[at + 1 :] if rng.random() < 0.7 else [*b[:at], "new", *b[at:]]
        x, y = (near.shingle_hashes(hashes(w)) for w in (a, b))
        if near.LEAST <= len(x) <= near.SHORT and near.LEAST <= len(y) <= near.SHORT and _similar(" ".join(a), " ".join(b)):
            met += 1
            assert set(near.smallest(x).tolist()) & set(near.smallest(y).tolist())
    assert met > 300


def test_alignment_takes_linear_memory():
    import tracemalloc

    rng = random.Random(4)
    a = [rng.randrange(1 << 60) for _ in range(60_000)]
    b = [x for x in a if rng.random() > 0.001]
    tracemalloc.start()
    assert near.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_recall_against_all_pairs(spark):
    """All pairs of a corpus of edited copies: at least nine in ten that are at 0.8 end in one class (short ones: all)."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((8, 12, 20, 28, 40, 90)))]
        for edits in (0, 1, 1, 2):
            copy = list(base)
            for _ in range(edits):
                copy[rng.choice((0, len(copy) - 1))] = rng.choice(words)
            texts.append(" ".join(copy))
    found = {r.doc_id: r.class_id for r in near.near_groups(_docs(spark, texts)).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a] != texts[b] and _similar(texts[a], texts[b])]
    caught = [found[a] == found[b] for a, b in pairs]
    print(f"near duplicates: {sum(caught)} of {len(pairs)} pairs of {len(texts)} texts")
    assert len(pairs) > 100 and sum(caught) >= 0.9 * len(pairs)
    assert all(c for c, (a, b) in zip(caught, pairs) if min(len(texts[a].split()), len(texts[b].split())) <= 28)


def test_null_ids_and_empty_table(spark):
    df = _docs(spark, ["x y", "x y", "z"], ids=[None, 4, 5])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in near.near_groups(df).collect())
    assert got == [(False, 4, True), (False, 5, True), (True, 0, True)]
    assert near.near_groups(df.limit(0)).count() == 0
    kept = near.keep_documents(_docs(spark, ["x y", "X y", "z"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and len(kept.columns) == 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    got = {r.id: r.component for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {v: v for e in edges for v in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {v: c for v, c in of.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_plan_uses_every_piece():
    rng = random.Random(2)
    for n in (0, 1, 5, 400):
        histogram = dict(Counter(rng.choice([rng.randrange(1, 4097), 4096, 2500, 300]) for _ in range(n)))
        made = packing.plan(histogram)
        used = Counter()
        for combination, times in made:
            assert sum(x * k for x, k in combination) <= 4096
            for x, k in combination:
                used[x] += k * times
        assert used == Counter(histogram)


def test_nnls_solves():
    histogram = {1000: 40, 3096: 30, 2048: 20, 548: 10}
    columns = packing.combinations(histogram)
    x = packing.nnls(columns, histogram)
    left = dict(histogram)
    for c, n in zip(columns, x):
        for length, times in c:
            left[length] -= times * n
    assert (x >= 0).all() and abs(left[2048]) < 1 and abs(left[3096]) < 3


def _check_packed(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for found in by.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_words_go_to_the_model_as_the_library_would_send_them():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCABULARY), packing.WordTokenizer(VOCABULARY)
    assert own.lowers and not packing.only_lowers({"model": {"type": "BPE"}})
    rng = random.Random(12)
    letters = "abETHéÉßÜñçÿÀØæªµº'’0٣ﬁ日ſİı\u0301\u0308"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "!?", "###", "'s", "$$$,", "<|endoftext|>", "|>", "…", "_", "-", "\\"]) for _ in range(6000)]
    joined = [" ".join(texts[k : k + 50]) for k in range(0, len(texts), 50)]
    for text, ids in zip(joined, own.ids(joined), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ascii_words_need_no_expression(monkeypatch):
    from tokenizers import Tokenizer

    class Counting:
        words: list = []

        def fullmatch(self, word):
            self.words.append(word)
            return plain.fullmatch(word)

    plain, own, library = packing._PLAIN, packing.WordTokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr(packing, "_PLAIN", Counting())
    rng = random.Random(11)
    words = ["Plain", "words,", "(not", "a.b", "", "...", "it's", "<|endoftext|>", "é", "Éa!", "ªb", "x1", "Straße?!", "日", "aA)"]
    words += ["".join(rng.choice("abZéÖ.,'<|1ªµ") for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    for word, ids in zip(words, own.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
        parts = plain.fullmatch(word)
        assert packing.plain_parts(word) == (parts and parts.groups())
    assert Counting.words and not any(word.isascii() for word in Counting.words)


def test_pack(spark):
    texts = [None, "", "Hello  wOrld\n\tit's", "a\x1cb ́e ﬁ ΣΑΣ <|endoftext|>", "x<|startoftext|> a <|endoftext|>y <| endoftext|>", "word " * 9000, "x" * 3000, *_corpus()]
    _check_packed(packing.pack(_docs(spark, texts), VOCABULARY).collect(), texts)
    assert packing.pack(_docs(spark, texts).limit(0), VOCABULARY).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from hazardry.llm import quality
    from tests.llm.test_native import _measures

    texts = _corpus() + ["# # # #" * 9, "y " * 40]
    _docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ok = []
    for k, t in enumerate(texts):
        m = dict(zip(quality.MEASURES, _measures(t)))
        if not any(eval(c, {}, m) for _, c in quality.RULES):  # noqa: S307  the rules are plain arithmetic
            ok.append(k)
    last = {(texts[k] or "").lower(): k for k in ok}
    ok = sorted(last.values())
    classes = _classes([texts[k] for k in ok], ok)
    assert {r.doc_id for r in rows} == set(classes.values())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
