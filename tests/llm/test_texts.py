"""The corpus operators on awkward texts, against plain Python."""

import collections
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import jpeg_media, packing, pii, quality, rollups, shingle_join, simhash, suffix_dedup
from larkspur.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge every box of black quartz and nobody minds at all today "
TEXTS = [
    None, "", " \n\t ", "one", "ab cd ef", PROSE, PROSE, PROSE + "x", PROSE * 3, "é ü ß 漢字 \U0001f600 " * 30, "a" * 5000, "x\n" * 40 + "y z\n" * 9, PROSE.upper(),
    "Mail bob.smith@example.co.uk or a@b.c_d@e.f now", "ip 10.0.0.1 and 1.2.3.4.5.6.7.8 or 999.1.1.1 v 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 12345",
    "call +49 (0)30 1234-567 or +1 or +12345678901234567", "IBAN GB82 WEST 1234 5698 7654 32 bank account", "my ssn 123-45-6789, not 123-45-67890", "漢字 x@y.zz " * 3,
    "1 " * 3000, "a.b" * 2000 + "@" + "c.d" * 2000, "reed*** " * 50, "  double  spaces \r\n here ", "<|endoftext|> text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, k, "clash", -1) for k, t in enumerate(TEXTS)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp bigint")


def empty(docs):
    return docs.limit(0)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_media_holds_every_byte(spark, docs):
    rows = collected(jpeg_media.media_features(jpeg_media.media_column(docs)))
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert jpeg_media.media_features(jpeg_media.media_column(empty(docs))).count() == 0


def test_media_of_several_frames_and_the_sequential_decoder():
    data = np.random.default_rng(3).integers(0, 256, jpeg_media.ROWS_MAX * 64 + 640, dtype=np.uint8).tobytes()
    stored = jpeg_media.encode(data)
    payload, feature = jpeg_media.decode(stored)
    assert payload == data and feature.startswith("2*512x")
    image = jpeg_media.images(jpeg_media.encode(data[:1280]))[0]
    whole = image._even_scan(1280)
    assert whole.tolist() == image._any_scan([(1, 1)], 1280)
    with pytest.raises(jpeg_media.MediaError):
        jpeg_media.decode(stored[:200])


def plain_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0

    def fine(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t) if fine(k, m.group())]


def test_personal_data(spark, docs):
    found = pii.find(docs)
    rows = collected(found.select("doc_id", pii.listing(F.filter("spans", lambda x: x["base"])).alias("base"), pii.listing(F.col("spans")).alias("all"), "spans"))
    for k, t in enumerate(TEXTS):
        assert rows[k].base == ",".join(plain_spans(t or "")), t[:80]
    assert "iban:5:32" in rows[17].all and "ssn:7:18" in rows[18].all and rows[18].all.count("ssn") == 1
    assert all(0 <= s.score <= 1 for r in rows.values() for s in r.spans)
    clean = collected(pii.redact(docs))
    assert clean[13].text == "Mail <EMAIL> or <EMAIL><EMAIL> now" and clean[0].text is None and clean[5].text == PROSE and clean[5].key == "clash"
    assert clean[19].text == "漢字 <EMAIL> " * 3
    assert pii.find(empty(docs)).count() == 0


def plain_added(t):
    """The added kinds by scanning: account numbers whose letters count 10 to 35 leave 1 modulo 97, numbers with context."""

    def scored(matches, k, prior, words, against=(), more=""):
        """The context of a match ends at the matches of its kind beside it."""
        start, stop = matches[k]
        low = max(start - 32, matches[k - 1][1] if k else 0)
        high = min(stop + 32, matches[k + 1][0] if k + 1 < len(matches) else len(t))
        near = f"{t[low:start]} {t[stop:high]} {more}".lower()
        found, bad = (any(re.search(rf"\b(?:{w})\b", near) for w in x) for x in (words, against))
        return prior + 0.25 * found - 0.25 * bad

    def right(v):
        v = v.replace(" ", "")
        return len(v) >= 15 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    known = {x[:2]: int(x[2:]) for x in pii._LENGTHS.split()}
    out, matches, tries, at = [], [], [], 0
    while m := re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}").search(t, at):
        at = m.start() + 1
        tail = re.compile(r"(?: ?[A-Z0-9])*").match(t, m.end()).group()
        ends = [k for k in range(len(tail) + 1) if (k == 0 or tail[k - 1] != " ") and not re.match("[A-Za-z0-9]", t[m.end() + k : m.end() + k + 1])]
        sizes = {k: 4 + len(tail[:k].replace(" ", "")) for k in ends}
        exact = [k for k in ends if sizes[k] == known.get(m.group()[:2])]
        loose = [k for k in ends if 15 <= sizes[k] <= 34]
        if exact or loose:
            at = m.end() + (exact or loose[-1:])[0]
            matches.append((m.start(), at))
            tries.append([at] if exact else sorted((m.end() + k for k in ends if m.end() + k <= at), reverse=True))
    for k, (start, stop) in enumerate(matches):
        end = next((e for e in tries[k] if right(t[start:e])), None)
        if end and scored(matches, k, 0.8, ("iban", "bank", "account", "transfer"), more=t[end:stop]) >= 0.5:
            out.append(f"iban:{start}:{end}")
    matches = [m.span() for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t)]
    return out + [f"ssn:{a}:{b}" for k, (a, b) in enumerate(matches) if scored(matches, k, 0.3, ("ssn", "social security", "taxpayer"), ("phone", "order")) >= 0.5]


def test_added_kinds_by_scanning(spark):
    rng = np.random.default_rng(12)

    def account(country, digits):
        body = "".join(map(str, rng.integers(0, 10, digits)))
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        return f"{country}{check:02d}{body}"

    def spaced(v):
        return " ".join(v[k : k + 4] for k in range(0, len(v), 4))

    texts = []
    for _ in range(150):
        bits = []
        for _ in range(int(rng.integers(1, 7))):
            number = account(*[("DE", 18), ("NO", 11), ("ZZ", 15), ("ZZ", 22), ("NL", 14)][rng.integers(0, 5)])
            wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
            bits.append([number, spaced(number), wrong, spaced(wrong), number + "X", "NOW PAY 12", "the word", "bank", "ssn", "order", "123-45-6789", "5-123-45-6789", "A B C", "taxpayer id"][rng.integers(0, 14)])
        texts.append(" ".join(bits))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = collected(pii.find(df).select("doc_id", pii.listing(F.filter("spans", lambda x: ~x["base"])).alias("added")))
    for k, t in enumerate(texts):
        assert found[k].added == ",".join(plain_added(t)), t


def test_very_many_spans_take_time_in_proportion(spark, tmp_path):
    def seconds(n):
        path = f"file://{tmp_path}/{n}"
        spark.createDataFrame([(1, "1." * (4 * n) + " mail a@b.c " * (n // 10))], "doc_id int, text string").write.parquet(path)
        began = time.perf_counter()
        found = pii.find(spark.read.parquet(path)).select(F.filter("spans", lambda x: x["kind"] == "ip").alias("ip"), F.filter("spans", lambda x: x["kind"] == "email").alias("email")).first()
        clean = pii.redact(spark.read.parquet(path)).first().text
        assert [(s.start, s.stop) for s in found.ip] == [(8 * k, 8 * k + 7) for k in range(n)] and len(found.email) == n // 10
        assert clean == "<IP>." * n + " mail <EMAIL> " * (n // 10)
        return time.perf_counter() - began

    seconds(2_000)
    assert seconds(50_000) < 30


def test_redaction_across_chunks(spark):
    texts = ["\U0001f600é" * 511 + f"{'x' * k} a@b.c 10.0.0.1" + "漢" * 1500 + " a.b@c.d 1.2.3.4" for k in range(6)] + ["a@b.c", "a@b.c" + "z " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    clean = collected(pii.redact(df))
    for k, t in enumerate(texts):
        out, at = [], 0
        for start, stop, kind in sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in plain_spans(t))):
            out += [t[at:start], f"<{kind.upper()}>"]
            at = stop
        assert clean[k].text == "".join([*out, t[at:]])


def test_personal_data_in_blocks_of_matches(spark):
    text = " ".join(f"u{k}@h{k}.org" for k in range(700))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = pii.find(df).first().spans
    assert [(s.start, s.stop) for s in found] == [m.span() for m in re.finditer(r"\S+", text)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_print(t, n=4):
    words = WORD.findall(lower(t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs):
    rows = collected(simhash.near_duplicates(docs))
    prints = {k: plain_print(t) for k, t in enumerate(TEXTS)}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 4 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    for k in prints:
        assert (rows[k].fp & (1 << 64) - 1, rows[k].component_id) == (prints[k], find(k))
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_narrower_tries_share_more_bits():
    for mask in [0, (1 << 22) - 1, 0x5555555555555555]:
        inner = simhash._narrower(mask)
        free = 64 - mask.bit_count()
        assert len(set(inner)) == 15 and all(m & mask == mask and m.bit_count() - mask.bit_count() >= 2 * (free // 6) for m in inner)
        # four bits may differ anywhere: two blocks always agree
        rng = np.random.default_rng(0)
        for _ in range(300):
            bits = sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))
            assert bits & mask or any(not bits & m for m in inner)


@pytest.mark.parametrize(("chunk", "split"), [(4, 1 << 20), (1024, 1 << 20), (4, 6), (1024, 10)])
def test_simhash_links_of_a_dense_group(spark, monkeypatch, chunk, split):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6)
    values = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 63, rng.integers(1, 7)):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    from larkspur.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if bin(a ^ b).count("1") <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def plain_quality(t):
    words = WORD.findall(t)
    grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_quality_statistics_and_verdicts(spark, docs):
    rows = collected(quality.verdicts(docs))
    for k, t in enumerate(TEXTS):
        n, chars, symbols, dup, repeat = plain_quality(t or "")
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
    assert rows[5].kept and not rows[22].kept and not rows[8].kept and not rows[0].kept
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([k for k in rows if rows[k].kept] + [6])
    assert quality.verdicts(empty(docs)).count() == quality.keep(empty(docs)).count() == 0


def test_cascade_order_does_not_change_the_verdict():
    texts = [(t or "").encode() for t in TEXTS]
    verdicts = set()
    for order in itertools.permutations(quality.RULES):
        verdicts.add(tuple(quality.Cascade(order).kept(quality.Statistics(t)) for t in texts))
    assert len(verdicts) == 1
    assert set(quality.Cascade().estimate(texts).rules) == set(quality.RULES)


def test_token_identifiers_equal_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours, end = Encoder(cache_words=10), "<|endoftext|>"
    assert np.frombuffer(ours.encode(f"hello {end} world"), "<u4").tolist() == [31373, 220, 50256, 995]
    for text in [*TEXTS, end, end * 3, f"in{end}side {end}{end}  two", f" {end} ", f"{end[:-1]} {end[1:]}", f"a \n{end}\n b", PROSE + end + PROSE]:
        assert np.frombuffer(ours.encode(text or ""), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_packing_loses_nothing(spark, docs):
    rows = packing.pack(docs.repartition(3), with_ids=True).collect()
    encoder, by_doc = Encoder(), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for k, t in enumerate(TEXTS):
        ids, copies = encoder.encode(t or "") + bytes(4), 2 if k == 6 else 1
        pieces = sorted(by_doc[k], key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in pieces) == copies * len(ids) // 4
        for r in pieces:
            assert r.ids == ids[4 * r.start : 4 * (r.start + r.length)] and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) // 4
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 3 * packing.SPARE
    assert packing.pack(empty(docs)).count() == 0


def test_packer_keeps_all_limits():
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=40)
    packer = packing.Packer(limits, 0, window=8)
    rng = np.random.default_rng(2)
    total = 0
    for k in range(300):
        n = int(rng.integers(1, 150))
        packer.add(packing.Piece(k, 0, n, int(rng.integers(0, n + 1))))
        total += n
    packer.finish()
    used = collections.defaultdict(lambda: [0, 0, 0])
    for piece, sequence, offset in packer.placed:
        assert offset == used[sequence][0]
        used[sequence] = [used[sequence][0] + piece.length, used[sequence][1] + 1, used[sequence][2] + piece.loss]
    assert all(a <= 64 and b <= 3 and c <= 40 for a, b, c in used.values()) and sum(a for a, _, _ in used.values()) == total


@pytest.mark.parametrize("size", range(1, 21))
def test_many_small_documents_need_no_padding(size):
    packer = packing.Packer(packing.Limits(), 0)
    for k in range(1500):
        packer.add(packing.Piece(k, 0, size, size - 1))
    packer.finish()
    used, pieces = collections.Counter(), collections.Counter()
    for piece, sequence, offset in packer.placed:
        assert offset == used[sequence]
        used[sequence] += piece.length
        pieces[sequence] += 1
    assert sum(used.values()) == 1500 * size and max(pieces.values()) <= 64
    assert all(u & (u - 1) == 0 or 1024 - u <= packing.SPARE for u in used.values())


def test_packing_of_conversations_by_roles(spark):
    rng = np.random.default_rng(7)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(PROSE.split(), rng.integers(0, 120)))) for c in range(40) for t in range(int(rng.integers(1, 7)))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", "yes"), (50, 1, "assistant", "yes"), (None, None, None, "x"), *((51, t, "assistant", f"w{t}") for t in range(150))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    made = packing.instructions(df)
    parts = {(r.key.conversation, r.key.stretch): r.parts for r in made.collect()}
    assert [len(parts[51, k]) for k in range(3)] == [64, 64, 22] and len(parts[50, 0]) == 2 and not parts[None, 0][0].loss
    limits = packing.Limits(tokens=256, segments=4, loss_tokens=100)
    out = packing.pack(made, key="key", parts="parts", limits=limits, with_ids=True).collect()
    encoder, by_key, sequences = Encoder(), collections.defaultdict(list), collections.defaultdict(lambda: [0, 0, 0])
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        by_key[r.key.conversation, r.key.stretch].append(r)
        used = sequences[r.sequence_id]
        assert r.offset == used[0]
        sequences[r.sequence_id] = [used[0] + r.length, used[1] + 1, used[2] + r.loss_tokens]
    assert by_key.keys() == parts.keys()
    for key, found in by_key.items():
        made_ids = [(np.frombuffer(encoder.encode(p.text), "<u4"), p.loss) for p in parts[key]]
        ids = np.concatenate([*(i for i, _ in made_ids), [0]])
        bears = np.concatenate([*(np.full(len(i), loss) for i, loss in made_ids), [False]])
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length].tolist()
            assert r.loss_tokens == bears[at : at + r.length].sum()
            at += r.length
        assert at == len(ids)
    used = np.array(list(sequences.values()))
    assert (used <= [256, 4, 100]).all() and (used.max(axis=0) == [256, 4, 100]).all()
    assert packing.pack(packing.instructions(df.limit(0)), key="key", parts="parts").count() == 0


def test_rollup_commits(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    one, other = rollups.Rollup(spark, path), rollups.Rollup(spark, path)
    row = spark.createDataFrame([("s", None, "t", 1, 5)], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
    odd = "../a b/%2F=é"
    assert one.commit(odd, row) and not other.commit(odd, row) and one.committed(odd) and not one.committed("a")
    # a writer that broke off has left a staged folder, which nothing reads
    row.write.parquet(f"{path}/staged-broken")
    row.write.parquet(f"{path}/staged-late")
    assert not one._put("staged-late", one._folder(odd))
    assert [tuple(r) for r in one.totals().collect()] == [("s", None, "t", 1, 5)]
    assert one.commit("b", row) and one.compact() and not one.compact()
    assert one._names("batch") == [] and not one.commit(odd, row) and one.committed("b")
    assert one.commit("c", row) and one.compact() and other.commit("d", row)
    assert [tuple(r) for r in other.totals().collect()] == [("s", None, "t", 4, 20)] and one._names("base") == ["base=000000000002"]


def test_rollups_are_additive_and_idempotent(spark, docs, tmp_path):
    counts = rollups.token_counts(docs)
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", rollups.events("insert", counts)) and not rollup.commit("a", rollups.events("insert", counts))
    assert rollup.commit("nothing", rollups.events("insert", counts.limit(0)))
    rollup.commit("b", rollups.events("delete", counts.where("doc_id = 5")))
    rollup.commit("c", rollups.events("revise", counts.where("doc_id = 8").selectExpr("source", "lang", "tokenizer", "n_tokens as old_tokens", "n_tokens + 7 as n_tokens")))
    encoder, want = Encoder(), collections.Counter()
    for r in docs.collect():
        n = len(encoder.encode(r.text or "")) // 4
        if r.doc_id != 5:
            want[(r.source, "docs")] += 1
            want[(r.source, "tokens")] += n + 7 * (r.doc_id == 8)
    got = {r.source: r for r in rollup.totals().collect()}
    assert {(s, "docs"): r.n_docs for s, r in got.items()} | {(s, "tokens"): r.n_tokens for s, r in got.items()} == dict(want)
    with pytest.raises(ValueError):
        rollups.events("other", counts)


def plain_removed(texts):
    seen, out = set(), {}
    for k, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            part = raw[s : s + 100]
            if part in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[k] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("often", "counted"), [(2, 2), (2, 1 << 30), (4096, 2)])
def test_repeated_passages(spark, docs, monkeypatch, often, counted):
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "STRETCH_OFTEN", counted)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 200)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 3000)
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(words, 40))
    made = [" ".join(rng.choice(words, 30)) + passage[a : a + 150] + " ".join(rng.choice(words, 20)) for a in rng.integers(0, 60, 25)]
    made += [m[:200] + "!" + m[200:] for m in made[:5]]
    texts = [(k, t) for k, t in enumerate([*TEXTS, *made])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    rows = collected(suffix_dedup.remove_repeated(df))
    want = plain_removed(texts)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in rows.items()} == want
    assert suffix_dedup.remove_repeated(empty(docs)).count() == 0


def plain_components(texts, n=5):
    sets = {}
    for k, t in texts:
        words = WORD.findall(lower(t or ""))
        sets[k] = {" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("chunk", [2, 1024])
def test_near_duplicates_down_to_the_similarity(spark, monkeypatch, chunk):
    monkeypatch.setattr(shingle_join, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(500)]
    made = []
    for _ in range(12):
        base = list(rng.choice(words, 120))
        for edits in (0, 1, 2, 2, 3, 4, 5):
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = str(rng.choice(words))
            made.append(" ".join(copy))
    texts = list(enumerate([*TEXTS, *made]))
    df = spark.createDataFrame([*texts, texts[6]], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(df).collect()}
    want = plain_components(texts)
    assert got == want
    narrow = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sum(k != c for k, c in narrow.items() if k >= len(TEXTS)) < sum(k != c for k, c in want.items() if k >= len(TEXTS))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {k for k, c in want.items() if k == c}


def test_account_numbers_before_capitals_and_digits(spark):
    number, spaced = "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"
    cases = [
        (f"IBAN {number} The money", [(5, 27)]), (f"IBAN {spaced} BIC ABCDEF", [(5, 32)]), (f"iban {number} 2024", [(5, 27)]), (f"{number} A", [(0, 22)]),
        (f"{spaced} DE89 3704 0044 0532 0130 00 NO93 8601 1117 947 X", [(0, 27), (28, 55), (56, 74)]),
        ("account ZZ33 1234 5678 9012 345 NOW PAY", [(8, 31)]), (f"{number}X", []), ("GB83WEST12345698765432 The", []), ("IBAN " + number, [(5, 27)]),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id int, text string")
    found = collected(pii.find(df))
    for k, (t, want) in enumerate(cases):
        assert [(s.start, s.stop) for s in found[k].spans if s.kind == "iban"] == want, t
    assert collected(pii.redact(df))[0].text == "IBAN <IBAN> The money"


def test_feature_describes_every_frame():
    data = np.random.default_rng(4).integers(0, 256, jpeg_media.ROWS_MAX * 64 + 640, dtype=np.uint8).tobytes()
    one, other = (jpeg_media.decode(jpeg_media.encode(x))[1] for x in (data, data[:-640] + data[-640:][::-1]))
    assert one != other and one.count("+") == 1 and one.split("+")[0] == other.split("+")[0]
    assert one.endswith(jpeg_media.decode(jpeg_media.encode(data[-640:]))[1])
