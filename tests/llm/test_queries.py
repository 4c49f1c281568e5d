"""Every query of the llm operators over the smallest test tables: against its SQL, or against a plain version in this process."""

import base64
import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from hazardry.llm import chat, near, queries

tokenizers_ = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def _table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def _rows(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet{'/*.parquet' if Path(FOLDER, 'documents.parquet').is_dir() else ''}'")
    found = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = Counter(tuple(x for _, x in sorted(zip(names, row))) for row in found.fetchall())
    got = [r.asDict() for r in _rows(spark, name)]
    assert Counter(tuple(x for _, x in sorted(r.items())) for r in got) == want


def test_op2(spark):
    talks = {}
    for r in sorted(_table("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    talks[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    got = {r.conv_id: r for r in _rows(spark, "op2_chat_formatting")}
    assert set(got) == set(talks)
    for k, turns in talks.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        want = ("".join(f"{r}\n{t}\n" for r, t in turns), learnt)
        assert (got[k].n_turns, got[k].loss_chars) == (len(turns), len(learnt))
        assert [got[k].turns_sha256, got[k].loss_sha256] == [hashlib.sha256(x.encode()).hexdigest() for x in want]
        assert got[k].formatted_chars >= sum(len(chat.OPEN + r + "\n" + t + chat.CLOSE) for r, t in turns)


def test_op3(spark):
    from hazardry.llm import urls

    rules = sorted(queries.PAGE_RULES, key=lambda r: -len(r[1]))
    weights = urls.model()
    got = {r.page_id: r for r in _rows(spark, "op3_url_filter")}
    pages = _table("pages")
    assert len(got) == len(pages)
    for page in pages:
        host, path = urls.split_url(page["url"] or "")
        rule = next((r for r in rules if (host + "/").endswith(r[1].partition("/")[0] + "/") and (host == r[1].partition("/")[0] or host.endswith("." + r[1].partition("/")[0])) and path.startswith("/" + r[1].partition("/")[2])), None)
        verdict = rule[0] if rule else "block" if urls.logits(weights, [host], [path])[0] >= 0 else "allow"
        r = got[page["page_id"]]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1], verdict)


def test_op4(spark):
    import tiktoken

    from hazardry.llm import bpe

    path = tokenizers_.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers_.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in _rows(spark, "op4_byte_bpe")}
    for d in _table("documents"):
        ids = np.array(library.encode_ordinary(d["text"] or ""), "<u4")
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())


def test_op5(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers_.path("word_bpe_49k.json"))
    rows = _rows(spark, "op5_packing")
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d in _table("documents"):
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_op6(spark):
    docs = _table("documents")
    hashes = near.WordHashes()
    made = {d["doc_id"]: near.Shingled(d["text"], hashes) for d in docs}
    ids = sorted(made)
    words = {d["doc_id"]: " ".join(near.tokens(d["text"])) for d in docs}
    pairs = [(a, b) for n, b in enumerate(ids) for a in ids[:n] if words[a] == words[b] or made[a].similar(made[b])]
    got = {r.doc_id: r for r in _rows(spark, "op6_near_dedup")}
    assert set(got) == set(ids) and all(got[k].class_id <= k and got[k].kept == (got[k].class_id == k) for k in ids)
    caught = sum(got[a].class_id == got[b].class_id for a, b in pairs)
    print(f"op6: {caught} of {len(pairs)} similar pairs of {len(ids)} documents end in one class")
    assert caught >= 0.9 * len(pairs)
    of = {k: k for k in ids}
    for _ in ids:
        changed = [(a, b) for a, b in pairs if of[a] != of[b]]
        for a, b in changed:
            of[a] = of[b] = min(of[a], of[b])
        if not changed:
            break
    assert all(of[got[k].class_id] == of[k] for k in ids)  # nothing is joined that isn't similar


def test_op7(spark):
    pages = {p["page_id"]: (p["html"] or "").encode() for p in _table("pages")}
    last = {}
    for k, raw in pages.items():
        last[raw] = max(k, last.get(raw, k))
    got = {r.page_id: r for r in _rows(spark, "op7_warc")}
    assert set(got) == set(pages)
    for k, raw in pages.items():
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[raw] == k else ("revisit", last[raw]))


def test_op1(spark):
    from tests.llm.test_text_models import WORD

    docs = _table("documents")
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = {d["doc_id"]: [*WORD.findall((d["text"] or "").encode().translate(low)), b""] for d in docs}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in words}
    seen = Counter(w for k, row in words.items() if not held[k] for w in row)
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in _rows(spark, "op1_lm_scoring")}
    bits = size = 0
    for k, row in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(row), sum(seen[w] > 0 for w in row), n)
        assert r.base_score == pytest.approx(sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in row), rel=1e-9)
        if held[k]:
            bits, size = bits - r.score / np.log10(2), size + r.n_bytes
    print(f"op1: {bits / size:.3f} bits a byte on {sum(held.values())} held-out documents")
    assert 0 < bits / size < 3
