"""Language-model scoring, byte-level BPE, chat formatting, URL filter and WARC."""

import base64
import hashlib
import json
import math
import pickle
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardry.llm import bpe, chat, mixing, urls, warc

tokenizers = pytest.importorskip("public_tokenizers")


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- scoring


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    parts = ["the", "and", "of", "ing", "tion", "er", "an"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(120)) + "." for _ in range(150)]
    texts += [None, "", "Zzz qqq", "é\n\x0b日"]
    return texts, {r.doc_id: r for r in mixing.score(_docs(spark, texts)).collect()}


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _base(texts):
    """(held out, tokens, known tokens, training tokens, base score) of each text, by counting."""
    tokens = [[w.decode() for w in WORD.findall((t or "").lower().encode())] + [""] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))]
    seen = Counter(w for k, row in enumerate(tokens) if not held[k] for w in row)
    n, v = sum(seen.values()), len(seen)
    return [(held[k], len(row), sum(seen[w] > 0 for w in row), n, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in row)) for k, row in enumerate(tokens)]


def test_base_score(scored):
    texts, got = scored
    for k, (held, tokens, known, n, base) in enumerate(_base(texts)):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)


def test_base_score_of_words_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FREQUENT", 20)  # words of over a twentieth are sent, the others are joined
    texts = ["a a a b c", "a b d", "a e\x00f g", None, "b b  a\tq", "a " * 50 + "zz", "A B zz"] * 3
    got = {r.doc_id: r for r in mixing.score(_docs(spark, texts)).collect()}
    for k, (held, tokens, known, n, base) in enumerate(_base(texts)):
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (held, tokens, known, n)
        assert got[k].base_score == pytest.approx(base, abs=1e-6)


def test_without_training_texts_the_base_is_its_formula(spark):
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    rows = spark.createDataFrame([(k, "some text here") for k in held], "doc_id long, text string")
    for r in mixing.score(rows).collect():
        assert (r.base_score, r.train_tokens, r.n_known, r.n_tokens) == (0.0, 0, 0, 4) and r.score < 0


def _sites(texts):
    return mixing.sites_of(next(iter(mixing.stretches(texts, 1 << 30))))


def test_mixing_sees_the_word_beyond_five_bytes():
    texts = ["x abcdefgh", "y  abcdefgh", "x qbcdefgh", "an of", "no of"]
    sites, starts = _sites(texts)
    last = sites[np.r_[starts[1:], len(sites)] - 2]  # before the end sign
    rows = [mixing.first_slots(last, k, 16)[0] for k in range(mixing.ORDERS)]
    for short in rows[:6]:  # five bytes don't tell the long words apart
        assert short[0] == short[1] == short[2]
    assert rows[-1][0] == rows[-1][1] != rows[-1][2]
    assert rows[5][3] != rows[5][4] and rows[-1][3] == rows[-1][4]


def test_mixing_learns(scored):
    texts, got = scored
    held = [r for r in got.values() if r.held_out and r.n_bytes > 100]
    bits = sum(-r.score for r in held) / math.log10(2) / sum(r.n_bytes for r in held)
    print(f"mixing: {bits:.2f} bits a byte on {len(held)} held-out texts")
    assert held and 0 < bits < 3
    assert all(r.score < 0 for r in got.values())


def test_scores_do_not_depend_on_partitions(spark, scored):
    texts, got = scored
    rows = _docs(spark, texts[:80] + [None, "long " * 3000])
    one, other = ({r.doc_id: r for r in mixing.score(rows.repartition(k)).collect()} for k in (2, 6))
    assert all(other[k].score == pytest.approx(r.score, rel=1e-9) and other[k].base_score == pytest.approx(r.base_score, rel=1e-9) for k, r in one.items())


def _model(texts, bits=12):
    sites, _ = _sites(texts)
    table = np.zeros((-(-mixing.slots(bits) // mixing.BLOCK) * mixing.BLOCK, 2), np.int64)
    for order in range(mixing.ORDERS):
        rows = mixing.first_slots(sites, order, bits)
        for place, node, bit in mixing.bits_of(sites):
            np.add.at(table, (rows[place >= 4] + mixing.node_in_row(place, node), bit), 1)
    model = mixing.untrained(bits, mixing.coded_pairs(table))
    random_ = np.random.default_rng(0)
    model.logits = random_.normal(size=model.logits.shape).astype(np.float32)
    model.weights += random_.normal(size=model.weights.shape).astype(np.float32) / 5
    return model, sites


def test_probabilities_sum_to_one():
    model, sites = _model(["the cat and the dog", "a cat"])
    every = (np.repeat(sites[4:5], 256) & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert (10 ** model.log10(every)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_those_of_a_plain_coder():
    """Bit by bit in text order, with dictionaries of contexts instead of hashed tables."""
    learnt, text = ["the cat and the dog sat", "a cat and a hat", "thereafter the catalogue"], "the hat and the catalogue"
    model, _ = _model(learnt, bits=20)

    def walk(text, see):
        history, word = b"\0" * 5, b""
        for byte in [*text.encode(), mixing.END]:
            known = [history[5 - k :] if k else b"" for k in range(6)] + [word]
            node = 1
            for place in range(8):
                bit = byte >> (7 - place) & 1
                see([(k, c, node) for k, c in enumerate(known)], place, node, bit)
                node = node * 2 + bit
            history = (history + bytes([byte]))[-5:]
            word = b"" if byte in mixing.BLANKS else word + bytes([byte])

    counts = Counter()
    for t in learnt:
        walk(t, lambda keys, place, node, bit: counts.update((*key, bit) for key in keys))
    total = 0.0

    def price(keys, place, node, bit):
        nonlocal total
        pairs = [int(mixing.coded_pairs(np.array([[counts[(*key, 0)], counts[(*key, 1)]]]))[0]) for key in keys]
        longest = max((k for k in range(1, 7) if pairs[k]), default=0)
        x = [float(model.logits[k][p]) for k, p in enumerate(pairs)] + [0.3]
        logit = max(-12.0, min(12.0, sum(a * float(w) for a, w in zip(x, model.weights[:, place * 7 + longest]))))
        refined = model.refined[node * mixing.BUCKETS + max(0, min(mixing.BUCKETS - 1, int((logit + 12) * mixing.BUCKETS / 24)))]
        p = (1 / (1 + math.exp(-logit)) + float(refined)) / 2
        total += math.log10(p if bit else 1 - p)

    walk(text, price)
    assert model.log10(_sites([text])[0]).sum() == pytest.approx(total, rel=1e-3)


def test_sites():
    sites, starts = _sites(["abc", "", "b"])
    assert [int(x) & 0xFFFF for x in sites] == [0x61, 0x6162, 0x6263, 0x63FF, 0xFF, 0x62, 0x62FF] and starts.tolist() == [0, 4, 5]


def test_long_texts_are_walked_in_stretches():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(300))) for _ in range(30)] + ["x" * 500, "x" * 200 + " y", " ", ""]
    whole, starts = _sites(texts)
    words, of = mixing.words_in(next(iter(mixing.stretches(texts, 1 << 30))))
    parts, size, found, owner = [], 0, [], []
    for group in mixing.stretches(texts, 64):
        parts.append(mixing.sites_of(group)[0])
        coded, stretch = mixing.words_in(group)
        found += coded.to_pylist()
        owner += [group[k][0] for k in stretch]
        size = max(size, len(group))
    assert np.array_equal(np.concatenate(parts), whole) and found == words.to_pylist() and owner == of.tolist() and size > 1
    assert found == [w for t in texts for w in WORD.findall(t.encode())]


def test_packed_counts():
    counts = np.random.default_rng(3).integers(0, 3, (mixing.BLOCK, 2))
    counts[5] = (255, 1 << 40)
    assert np.array_equal(mixing._unpack(mixing._pack(counts)), counts)


def test_mixing_adds_counts_in_little_memory():
    rng = np.random.default_rng(4)
    parts = [mixing.distinct(rng.integers(1, 900_000, 300_000, dtype=np.uint64) * np.uint64(7919)) for _ in range(8)]
    tracemalloc.start()
    sites, n = mixing.merged(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = mixing.distinct(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]))
    assert np.array_equal(sites, whole[0]) and np.array_equal(n, whole[1])
    assert peak < 1.7 * sum(x.nbytes + n.nbytes for x, n in parts)


def test_mixing_tables_travel_compressed():
    table = np.random.default_rng(5).integers(0, 2, mixing.PIECE + 4096).astype(np.uint8)
    model = mixing.untrained(16, table)
    packed = pickle.dumps(model)
    assert len(packed) < len(table) / 2
    got = pickle.loads(packed)
    assert np.array_equal(got.table, table) and got.bits == 16 and all(np.array_equal(x, y) for x, y in zip(got.maps(), model.maps(), strict=True))


def test_scoring_an_empty_table_and_clashing_columns(spark):
    assert mixing.score(_docs(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a b", 3.0, "w"), (1, "a b", 4.0, "x"), (None, None, None, None)], "doc_id long, text string, score double, word string")
    got = mixing.score(rows).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1


# --- byte-level BPE

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_against_the_library(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    rng = random.Random(4)
    texts = [None, "", "Hello world", "<|endoftext|> it's", " " * 40 + "x", "é日\U0001f600", "thth" * 100, "ha" * 500, "=" * 900, "aaaaaaa" * 100]
    texts += ["".join(rng.choice("abeht =-\n\té日") for _ in range(rng.randrange(200))) for _ in range(60)]
    for rows in (bpe.round_trip(_docs(spark, texts), PATH, tokenizers.PATTERN), bpe.decode(bpe.encode(_docs(spark, texts), PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN)):
        for r in rows.collect():
            text = texts[r.doc_id] or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(r.decoded).decode() == text
            assert r.n_tokens == len(library.encode_ordinary(text))


def test_both_contractions_agree():
    codec = bpe.codec_of(PATH, tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(40):
        word = "".join(rng.choice("thaeinr") for _ in range(rng.randrange(2, 60)))
        out = [None]
        codec._contract([(0, word.encode())], out)
        assert out[0] == codec.contract_long(word.encode())
    long = ["".join(rng.choice("thaeinr") for _ in range(1500)), "=" * 700, "ha" * 300, "x"]  # many rounds, some words done early
    out = [None] * 4
    codec._contract([(k, x.encode()) for k, x in enumerate(long)], out)
    assert out == [codec.contract_long(x.encode()) for x in long]


def test_decoding_joins_once():
    """The bytes of an aggregation by text, in less than 0.6 of its CPU time."""
    codec = bpe.codec_of(PATH, tokenizers.PATTERN)
    rng = np.random.default_rng(7)
    known = np.array(sorted(codec.ranks.values()), "<u4")
    rows = [known[rng.integers(0, len(known), n)].tobytes() for n in (0, 1, 40_000, 0, 160_000)]
    rows.append(np.array([0, 1 << 30, 1], "<u4").tobytes())  # an id that no token has stands for no bytes
    db = codec.db.cursor()
    db.register("incoming", pa.table({"id": pa.array(list(codec.ranks.values()), pa.int32()), "h": [x.hex() for x in codec.ranks]}))
    db.execute("CREATE TEMP TABLE hexes AS SELECT * FROM incoming")

    def aggregated():
        lengths = [len(row) // 4 for row in rows]
        tokens = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
        db.register("ids", pa.table({"d": np.repeat(np.arange(len(rows)), lengths), "p": np.arange(len(tokens)), "t": tokens}))
        found = dict(db.execute("SELECT d, unhex(string_agg(h, '' ORDER BY p)) FROM ids JOIN hexes ON id = t GROUP BY d").fetchall())
        return [bytes(found.get(k, b"")) for k in range(len(rows))]

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    assert codec.decode(rows) == aggregated() and codec.decode([]) == [] and codec.decode([b"", b""]) == [b"", b""]
    assert min(seconds(lambda: codec.decode(rows)) for _ in range(3)) < 0.6 * min(seconds(aggregated) for _ in range(3))


# --- chat


def test_layouts(spark):
    said = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
    ]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(said)] + [(9, '{"odd": [1]}'), (10, "no json"), (11, None)], "conv_id long, record string")
    turns = chat.canonical_turns(rows).collect()
    for k in range(len(said)):
        assert [(r.turn, r.role, r.text) for r in turns if r.id == k] == [(0, "user", "q"), (1, "assistant", "a")]
    assert {r.id for r in turns if r.unmapped} == {9, 10, 11}


def test_format_and_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\<s>\\", "<|turn|>user\nx<|end|>\n", "", None, "<<SYS>><</SYS>>", "<|tu", "x" * 50000]
    roles = ["user", "assistant", None]
    rows = [(7, k, roles[k % 3], t) for k, t in enumerate(texts)] + [(8, 0, "assistant", "only"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "id long, turn long, role string, text string")
    formatted = chat.format_turns(turns)
    for r in formatted.collect():
        inside = r.segment[len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(c in inside for c in chat.CONTROL)
        want = next(x for x in rows if x[:2] == (r.id, r.turn))
        assert chat.read_segment(r.segment) == (want[2] or "", want[3] or "")
    got = {r.id: r for r in chat.digests(formatted).collect()}
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:9])
    learnt = "".join(t or "" for _, _, r, t in rows[:9] if r == "assistant")
    assert got[7].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[7].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert (got[7].n_turns, got[7].loss_chars, got[8].loss_chars, got[None].loss_chars) == (9, len(learnt), 4, 0)
    assert chat.digests(formatted.limit(0)).count() == 0


def test_roles_with_line_ends_and_whole_conversations(spark):
    rows = [(1, 0, "user\nx", "y"), (1, 1, "a\\\n\\", "\\\n<|end|>\n"), (1, 1, "a\\\n\\", "\\\n<|end|>\n"), (1, None, "", ""), (2, 0, "\n", "\n\n")]
    records = spark.createDataFrame([(i, json.dumps({"conv_id": i, "turn": t, "role": r, "text": x}), "extra") for i, t, r, x in rows], "conv_id long, record string, role string")
    formatted = chat.format_turns(chat.canonical_turns(records))
    by = {}
    for r in formatted.orderBy("id", "turn", "role", "segment").collect():
        by.setdefault(r.id, []).append(r.segment)
    want = {1: [("", ""), ("user\nx", "y"), *[rows[1][2:]] * 2], 2: [("\n", "\n\n")]}
    assert {k: chat.read_conversation("".join(x)) for k, x in by.items()} == want
    reader, got = chat.Reader(), []
    for character in "".join(by[1]):
        got += reader.feed(character)
    reader.close()
    assert got == want[1]
    with pytest.raises(ValueError):
        chat.read_conversation("".join(by[1])[:-1])
    told = "".join(f"{r}\n{t}\n" for r, t in want[1])
    assert {r.id: (r.n_turns, r.turns_sha256) for r in chat.digests(formatted).collect()}[1] == (4, hashlib.sha256(told.encode()).hexdigest())


# --- URLs


def test_url_parts_and_rules(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    rows = [(1, "http://A.Example.COM/en/71?x"), (2, "http://example.com/en/1"), (3, "x://sub.example.net/de/8"), (4, "y://net/de/1#a"), (5, "http://xnet/de/1"), (6, None), (7, "no scheme"), (8, "a://b://c/d?e"), (9, "http://q.org?/es/"), (10, "http://h/a\nb")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, urls.model()).collect()}
    part = {k: (r.host, r.path, r.rule) for k, r in got.items()}
    assert part == {
        1: ("a.example.com", "/en/71", "example.com/en/7"), 2: ("example.com", "/en/1", "com/en/"), 3: ("sub.example.net", "/de/8", "example.net/de/8"), 4: ("net", "/de/1", "net/de/"),
        5: ("xnet", "/de/1", None), 6: ("", "", None), 7: ("", "", None), 8: ("b:", "//c/d", None), 9: ("q.org", "", None), 10: ("h", "/a\nb", None),
    }
    assert [got[k].verdict for k in (1, 2, 3, 4)] == ["allow", "block", "block", "allow"]


def test_url_model_on_held_out_hosts(spark):
    weights = urls.model()
    bad, good = ["m.casino-win.example.com", "free-bets.example.org", "www.cheap-pills.example.net"], ["ththere.example.com", "blog.erantion.example.org", "www.garden-news.example.net"]
    value = urls.logits(weights, bad + good, ["/en/1"] * 6)
    assert (value[:3] > 0).all() and (value[3:] < 0).all()
    table = spark.createDataFrame([("http://aaa/x", 1), ("http://bbb/x", 0), (None, 0)], "url string, label int")
    own = urls.model(table)
    assert urls.logits(own, ["aaa"], ["/x"])[0] > urls.logits(own, ["bbb"], ["/x"])[0]


def test_url_accuracy_on_names_held_out():
    share = urls.accuracy(urls.built_in_table())
    print(f"urls: {share:.3f} of the built-in table's urls judged rightly by models of other names")
    assert share >= 0.85
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "su", "re", "ton"]
    host = lambda kind: "".join(rng.choice(syllables) for _ in range(3)) + rng.choice(("bet", "slot") if kind else ("edu", "lib")) + "".join(rng.choice(syllables) for _ in range(2))
    pairs = [(f"http://{host(k % 2)}.example.com/{rng.randrange(99)}", k % 2) for k in range(300)]
    assert urls.accuracy(pairs) >= 0.9


def test_labelled_rows_are_chosen_by_hash(spark):
    rows = [(f"http://{k}.org/", k % 2) for k in range(60)]
    one = spark.createDataFrame(rows, "url string, label int")
    other = spark.createDataFrame(rows[::-1], "url string, label int").repartition(5)
    assert urls.labelled_pairs(one, most=20) == urls.labelled_pairs(other, most=20) and len(urls.labelled_pairs(one, most=20)) == 20
    assert urls.labelled_pairs(one.limit(0)) == [] and not urls.trained([]).any()


def test_urls_of_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "http://a/x", "v")] * 2 + [(None, "http://" + "h" * 50_000 + "/" + "p" * 50_000, "w")], "page_id long, url string, verdict string")
    got = urls.judge(rows, [], urls.model()).collect()
    assert len(got) == 3 and {len(r.host) for r in got} == {1, 50_000} and all(r.rule is None and r.verdict in ("allow", "block") for r in got)
    assert urls.judge(rows.limit(0), [("block", "a/")], urls.model()).count() == 0
    urls_ = ["HTTP://A.b/C?d", "x", "a://b#c", "a://q/w://e", "://", ""]
    parts = urls.split_urls(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), "page_id", "url").collect()
    assert {r.page_id: (r.host, r.path) for r in parts} == {k: urls.split_url(u) for k, u in enumerate(urls_)}


# --- WARC


def _pages(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (5, "http://c", "same"), (3, "u\r\nv", None), (4, None, ""), (6, "http://d", "é" * 5000), (7, "http://e", "WARC/1.1\r\n\r\n" * 3)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string"), {r[0]: r[2] or "" for r in rows}


def test_warc_round_trip(spark):
    df, texts = _pages(spark)
    got = {int(r.record_id.rpartition(":")[2]): r for r in warc.round_trip(df, keep_payload=True).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        top = max(i for i, t in texts.items() if t == text)
        raw = text.encode()
        r = got[k]
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("response" if k == top else "revisit", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.refers_to == (None if k == top else f"urn:page:{top}") and (k != top or bytes(r.payload) == raw)
    assert warc.round_trip(df, least=5).filter("record_type = 'revisit'").count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.record("response", f"urn:page:{k}", "http://x", f"body {k} ".encode() * 40) for k in range(5)]
    parts = [warc.member(p) for p in parts] if packed else parts
    whole = b"".join(parts)
    assert [f is not None for _, f, _, _ in warc.salvage(whole)] == [True] * 5
    broken = bytearray(whole)
    hurt = len(parts[0]) + len(parts[1]) // 2
    broken[hurt : hurt + 4] = b"\xff\x00\xff\x00"
    found = list(warc.salvage(bytes(broken) + b"tail"))
    ids = [f.fields["warc-record-id"] for _, f, _, _ in found if f]
    gaps = [(at, size) for at, f, size, _ in found if f is None]
    assert ids == [f"<urn:page:{k}>" for k in (0, 2, 3, 4)]
    assert gaps == [(len(parts[0]), len(parts[1])), (len(whole), 4)] and all(reason for _, f, _, reason in found if f is None)
    # a member that lacks its trailer still holds a whole record; one that lacks more doesn't
    for lack, there in ((9, 5 if packed else 4), (60, 4)):
        cut = list(warc.salvage(whole[: len(whole) - lack]))
        assert sum(f is not None for _, f, _, _ in cut) == there and cut[-1][2] == len(parts[4]) - lack


def test_salvage_within_members():
    parts = [warc.record("response", f"urn:page:{k}", "http://x", f"body {k} ".encode() * 40) for k in range(5)]
    ids = lambda events: [f.fields["warc-record-id"][10:-1] for _, f, _, _ in events if f]
    many = warc.member(b"".join(parts[:3]))
    assert ids(warc.salvage(many + warc.member(parts[3]))) == ["0", "1", "2", "3"]
    inner = list(warc.salvage(warc.member(parts[0] + b"noise" + parts[1]) + warc.member(parts[2])))
    assert ids(inner) == ["0", "1", "2"] and [(size, reason) for _, f, size, reason in inner if f is None] == [(5, "within a member: no version line")]
    noise = random.Random(2).randbytes(40_000)
    large = warc.member(parts[0] + parts[1] + warc.record("response", "urn:page:9", "u", noise))
    cut = list(warc.salvage(large[:-9000] + warc.member(parts[4])))
    assert ids(cut) == ["0", "1", "4"] and sum(size for _, f, size, _ in cut if f is None) == len(large) - 9000
    assert list(warc.salvage(b"")) == [] and ids(warc.salvage(warc.member(b"nothing") + parts[0] + warc.member(parts[1]))) == ["0", "1"]


def test_archives_are_read_by_pages(tmp_path):
    from pyarrow import fs

    parts = [warc.record("response", f"urn:page:{k}", "http://x", random.Random(k).randbytes(3000 + k)) for k in range(40)]
    raw = b"junk" + b"".join(warc.member(p) if k % 3 else p for k, p in enumerate(parts))
    (tmp_path / "a").write_bytes(raw)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as file:
        paged = [(at, f and f.block, size, reason) for at, f, size, reason in warc.salvage(warc.Remote(file, 512))]
    assert paged == [(at, f and f.block, size, reason) for at, f, size, reason in warc.salvage(raw)] and len(paged) == 41


def test_reading_takes_linear_time():
    import time

    part = warc.member(warc.record("response", "urn:page:1", "http://x", random.Random(1).randbytes(9000)))
    raw = part * (35_000_000 // len(part))
    start = time.process_time()
    assert sum(f is not None for _, f, _, _ in warc.salvage(raw)) == len(raw) // len(part)
    assert time.process_time() - start < 5
