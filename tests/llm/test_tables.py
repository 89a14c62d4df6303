"""Archives, mixing, language identification and the pipeline on small tables."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from larkspur.llm import archives, langid, mixing, queries, simhash
from larkspur.llm.common import stored

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://a/ b\n", "<p>one</p>"), (4, "", None), (5, "http://c", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", "<p>one</p>"), (None, "n", "<p>two</p>"), (-9, "neg", "x" * 3_000_000)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(2)
    arcs = stored(archives.write_arcs(df), "arcs")
    rows = archives.read_warcs(stored(archives.to_warcs(arcs), "warcs")).collect()
    first = {}
    for key, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", key)
    want = collections.Counter()
    for key, _, html in PAGES:
        raw, to = (html or "").encode(), first.get(html or "")
        again = to != key
        want[(key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None)] += 1
    assert collections.Counter(tuple(r) for r in rows) == want
    assert archives.read_warcs(archives.to_warcs(stored(archives.write_arcs(df.limit(0)), "arcs"))).count() == 0


def test_archives_of_several_tasks_with_equal_keys(spark):
    # two tasks whose archives hold null identifiers alone, then one page with a payload of the first task
    rows = [[(None, None, f"{task}{k}") for k in range(4)] for task in "AB"] + [[(7, None, "A1"), (7, None, "A1"), (8, "u", "B3"), (8, "v", "B3")]]
    sc = spark.sparkContext
    df = spark.createDataFrame(sc.parallelize([r for part in rows for r in part], 3), "page_id bigint, url string, html string")
    arcs = stored(archives.write_arcs(df), "arcs")
    names = [r.name for r in arcs.select("name").collect()]
    assert len(names) == len(set(names)) == 3
    found = collections.Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in archives.read_warcs(stored(archives.to_warcs(arcs), "warcs")).collect())
    code = {x: archives.digest(x.encode()) for part in rows for _, _, x in part}
    want = collections.Counter({(None, code[x], "response", None): 1 for x in code if x not in ("A1", "B3")})
    want += collections.Counter({(None, code["A1"], "revisit", 7): 1, (None, code["B3"], "revisit", 8): 1, (7, code["A1"], "response", None): 2, (8, code["B3"], "response", None): 2})
    assert found == want
    with pytest.raises(archives.ArchiveError):
        archives.to_warcs(arcs.unionByName(arcs))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    pages = [(1, "http://x/y z", b"abc"), (2, None, b""), (3, "http://w", b"\n\nfiledesc://")]
    data = archives.arc_archive("n.arc", version, pages)
    found = list(archives.read_arc(data))
    assert [r.content[r.payload_at() :] for r in found] == [p[2] for p in pages]
    assert found[0].fields["URL"] == "http://x/y%20z" and found[1].fields["URL"] == "urn:page:2"
    with pytest.raises(archives.ArchiveError):
        list(archives.read_arc(data[:-20]))
    records = list(archives.read_warc(archives.convert("n.arc", data, [1, 2, 3], {2: 1})))
    assert [h["WARC-Type"] for h, _ in records] == ["warcinfo", "response", "response", "revisit"]
    assert archives.page_of(records[3][0]["WARC-Refers-To"]) == 1 and archives.page_of(archives.record_id(-5)) == -5


def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(n)), f"s{k % 4}" if k % 4 else None) for k, n in enumerate(rng.integers(0, 60, 400))]
    rows += [(1000, "w " * 500, "tiny"), (1001, None, "tiny"), (1002, "", "empty"), (1003, "a b", "s1"), (1003, "a b", "s1"), (None, "c d e", "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).join(df, "doc_id", "left").dropDuplicates(["doc_id"]).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / w > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in order}
    for r in got:
        if r.doc_id is not None:
            assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
    taken = collections.Counter()
    again = {}
    for r in mixing.mix(df).collect():
        assert 0 <= r.taken <= 3 * r.size
        again.setdefault(r.doc_id, []).append(r.taken)
        taken[r.target] += r.taken
    for t in set(target.values()):
        assert taken[t] == pytest.approx(t * sum(1 for v in target.values() if v == t), abs=1.01 * 3)
    second = collections.defaultdict(list)
    for r in mixing.mix(df.repartition(5)).collect():
        second[r.doc_id].append(r.taken)
    assert {k: sorted(v) for k, v in again.items()} == {k: sorted(v) for k, v in second.items()}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply_mix(df.limit(0)).count() == 0


def test_mix_solves_its_dual_and_rounds_it_in_order(spark):
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(["w"] * int(n)), s) for k, (n, s) in enumerate(zip(np.exp(rng.normal(3, 1, 900)).astype(int), rng.choice(list("abcdef"), 900, p=[0.4, 0.2, 0.2, 0.1, 0.06, 0.04]), strict=True))]
    rows += [(2000 + k, "v " * 7, "g") for k in range(30)] + [(3000, "u " * 4000, "h"), (3001, "u", "h"), (3002, None, "i")]
    df = spark.createDataFrame([(k, t, str(s)) for k, t, s in rows], "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix(df).join(df.drop("text"), "doc_id").collect()
    words = sum(r.size for r in got)
    mean = sum(r.size * np.log(r.size) for r in got if r.size) / words
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    tilts = 0
    for source, docs in by_source.items():
        size, rate = np.array([r.size for r in docs], float), np.array([r.rate for r in docs])
        target, z = docs[0].target, np.log(np.maximum(size, 1)) - mean
        assert rate.max() <= 3 and abs(rate @ size - target) <= 1e-6 * max(target, 1)
        if not target or target >= 3 * size.sum():
            assert set(rate) == {3.0 if target else 0.0}
            continue
        # ln rate is a line in log size where the limit does not bind, and the second constraint holds by ridge
        inside = (rate < 3) & (size > 0)
        if len(set(size[inside])) > 2:
            b, a = np.polyfit(z[inside], np.log(rate[inside]), 1)
            np.testing.assert_allclose(np.log(rate[inside]), a + b * z[inside], atol=1e-6)
            assert abs(rate * size @ z + mixing.RIDGE * target * b) <= 1e-5 * target
            tilts += len(set(rate)) > 5
    assert tilts >= 4
    # copies: whole parts, then ascending hash over fractional part until the target is reached
    def uniform(key):
        return (xxhash.xxh64_intdigest(b"mix", xxhash.xxh64_intdigest(int(key).to_bytes(8, "little"), 42)) >> 12) / 2**52

    for docs in by_source.values():
        extra = int(docs[0].target + 0.5) - sum(int(r.rate) * r.size for r in docs)
        want = {r.doc_id: int(r.rate) * r.size for r in docs}
        for r in sorted((r for r in docs if r.rate % 1), key=lambda r: uniform(r.doc_id) / (r.rate % 1)):
            want[r.doc_id] += max(0, min(r.size, extra))
            extra -= r.size
        assert {r.doc_id: r.taken for r in docs} == want


LANGUAGES = {"en": "the of and to with that this from which have", "de": "der die und nicht mit auch eine werden über für", "fr": "le les des que dans est pour une avec plus"}


def sentences(rng, lang, n):
    return " ".join(rng.choice(LANGUAGES[lang].split(), n))


def test_language_of_documents_and_words(spark):
    rng = np.random.default_rng(1)
    rows = [(k, sentences(rng, lang, 40), lang) for k, lang in enumerate(np.array(list(LANGUAGES))[rng.integers(0, 3, 300)])]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (903, "the and " * 20000, None), (904, "DER die UND", None)]
    df = spark.createDataFrame([(k, t, None if x is None else str(x)) for k, t, x in rows], "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [(k, x) for k, _, x in rows[:300] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].lang_pred == x for k, x in held) >= 0.95 * len(held)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "en" and got[904].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    words = langid.label(["the and of with this from der die und nicht mit auch"], model)[0][2]
    assert [model.languages[k] for k in words[1:5]] == ["en"] * 4 and [model.languages[k] for k in words[-4:]] == ["de"] * 4
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    emission, change = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    posterior, _, _ = langid.forward_backward(emission, change, np.array([4]))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        score = np.exp(sum(emission[t, 0, k] for t, k in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, k in enumerate(path):
            want[t, k] += score
    np.testing.assert_allclose(posterior[:, 0], want / want.sum(axis=1, keepdims=True), rtol=1e-9)


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(400)]
    clean = [(k, " ".join(rng.choice(words, 60)) + f" mail u{k}@example.org", "en", f"s{k % 3}", 1, 7) for k in range(40)]
    rows = [*clean, (100, clean[0][1], "en", "s0", 1, 7), (101, "too short", "en", "s1", 1, 7), (102, None, None, None, None, 7), clean[3], (103, "junk*** " * 50, "en", "s1", 1, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {*range(40), 100}
    single = corpus_pipeline.near_dedup(spark, kept, "")
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted({k for k, c in component.items() if k == c}) and component[100] == 0
    private = corpus_pipeline.personal_data(spark, single, "")
    assert private.columns == df.columns and all(r.text.endswith("mail <EMAIL>") and r.n_chars == len(r.text) for r in private.collect())
    mixed = corpus_pipeline.mix_sources(spark, private, "")
    assert mixed.columns == df.columns and 0 < mixed.count() <= 3 * private.count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_query_of_each_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_long_words_are_read_to_their_ends():
    rng = np.random.default_rng(6)
    head = "".join(map(chr, range(97, 117)))
    made = [(head + "".join(rng.choice(list(letters), 200)), lang) for lang, letters in (("xx", "山水火木金"), ("yy", "あいうえお")) for _ in range(40)]
    model = langid.train(made)
    found = langid.label([t for t, _ in made] + [head + "山水火木金" * 9, head + "あいうえお" * 9], model)
    assert [x[0] for x in found] == [x for _, x in made] + ["xx", "yy"]
    word = "".join(map(chr, rng.integers(97, 123, 75)))
    pieces = langid.words_of(word)
    assert pieces[-1].endswith(word[-3:]) and {word[k : k + 3] for k in range(73)} == {p[k : k + 3] for p in pieces for k in range(len(p) - 2)}
    for n in (20, 21, 22, 23, 38, 39):
        cut = langid.words_of(word[:n])
        assert "".join([cut[0], *(p[2:] for p in cut[1:])]) == word[:n] and all(len(p) <= langid.LENGTH for p in cut)
