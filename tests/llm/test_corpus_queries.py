"""Every query of the corpus operators, and the pipeline, over whole small tables."""

import base64
import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import mixing, queries
from test_texts import WORD, plain_print, plain_removed, plain_spans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet'").fetchall()
    return {k: (t or "", lang, source) for k, t, lang, source in rows}


def run(spark, name, key="doc_id"):
    found = {}
    for r in queries.QUERIES[name](spark, DATA).collect():
        found.setdefault(r[key], []).append(r)
    return found


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op1(spark, documents):
    found = run(spark, "op1_media")
    assert found.keys() == documents.keys()
    for k, (t, _, _) in documents.items():
        (r,), raw = found[k], t.encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > len(padded) and len(r.media_sha256) == 64 and r.feature


def test_op2(spark, documents):
    found = run(spark, "op2_pii")
    assert found.keys() == documents.keys()
    for k, (t, _, _) in documents.items():
        (r,), spans = found[k], plain_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        kinds = collections.Counter(s.split(":")[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[x] for x in ("email", "ip", "card", "phone"))
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_op3(spark, documents):
    found = run(spark, "op3_simhash")
    prints = {k: plain_print(t) for k, (t, _, _) in documents.items()}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {k: (r[0].fingerprint, r[0].component_id) for k, r in found.items()} == {k: (f"{prints[k]:016x}", find(k)) for k in prints}


def test_op4(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()
    first = {}
    for k, html in sorted(pages):
        first.setdefault(html or "", k)
    found = run(spark, "op4_archives", "page_id")
    assert len(found) == len(pages)
    for k, html in pages:
        (r,), raw, to = found[k], (html or "").encode(), first[html or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == k else "revisit", None if to == k else to)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_op5(spark, documents):
    found = run(spark, "op5_mixing")
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for k, (t, _, source) in documents.items():
        (r,) = found[k]
        assert r.size == len(WORD.findall(t)) and 0 <= r.taken <= 3 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    order = sorted(sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while over := {s for s in order if s not in full and (total - sum(3 * sizes[f] for f in full)) * weight[s] / sum(weight[x] for x in order if x not in full) > 3 * sizes[s]}:
        full |= over
    level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
    for s in order:
        assert target[s] == pytest.approx(3 * sizes[s] if s in full else level * weight[s]) and abs(taken[s] - target[s]) <= 1
    assert {k: r[0].taken for k, r in run(spark, "op5_mixing").items()} == {k: r[0].taken for k, r in found.items()}


def test_op6(spark, documents):
    want = plain_removed(sorted((k, t) for k, (t, _, _) in documents.items()))
    assert {k: (r[0].n_bytes, r[0].n_removed, r[0].n_spans, r[0].kept_sha256) for k, r in run(spark, "op6_suffix_dedup").items()} == want


def test_op7(spark, documents):
    found = run(spark, "op7_langid")
    assert found.keys() == documents.keys()
    held = [k for k in documents if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(found[k][0].held_out == (k in held) and 0 <= found[k][0].score <= 1 for k in documents)
    assert sum(found[k][0].lang_pred == documents[k][1] for k in held) >= 0.95 * len(held)


def test_op8(spark, documents):
    tokens, found, used = tokenizer(), run(spark, "op8_packing"), collections.Counter()
    assert found.keys() == documents.keys()
    places = []
    for k, (t, _, _) in documents.items():
        ids, at = np.array([*tokens.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(found[k], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length].tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part)
            places.append((r.sequence_id, r.offset, r.length))
            at += r.length
        assert at == len(ids)
    for sequence, offset, length in sorted(places):
        assert offset == used[sequence]
        used[sequence] += length
    padding = sum(0 if u & (u - 1) == 0 else 1024 - u for u in used.values())
    assert max(used.values()) <= 1024 and padding <= 0.01 * sum(used.values())


def test_op9(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["op9_quality"]).fetchall()}
    assert {k: tuple(r[0])[1:] for k, r in run(spark, "op9_quality").items()} == want


@pytest.mark.parametrize("name, table", [("op11_topk", "embeddings"), ("op12_negatives", "embeddings"), ("op13_infill", "documents")])
def test_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_op10(spark, documents):
    from larkspur.llm.tokens import Encoder

    want = collections.Counter()
    for vocabulary in ("byte_bpe_50k.json", queries.NEXT_VOCABULARY):
        encoder = Encoder(vocabulary)
        for t, lang, source in documents.values():
            single = "\n".join(dict.fromkeys(t.split("\n")))
            there = len(WORD.findall(t)) >= queries.FEWEST_WORDS
            want[source, lang, vocabulary, "docs"] += there
            want[source, lang, vocabulary, "tokens"] += there * len(encoder.encode(single)) // 4
    got = {}
    for r in queries.op10_rollups(spark, DATA).collect():
        got |= {(r.source, r.lang, r.tokenizer, "docs"): r.n_docs, (r.source, r.lang, r.tokenizer, "tokens"): r.n_tokens}
    assert got == dict(want)


def test_pipeline(spark, documents):
    out = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in out}
    assert 0.25 * len(documents) < len(kept) < len(documents) and kept <= documents.keys()
    used = collections.Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
