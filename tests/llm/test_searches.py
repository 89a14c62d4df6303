"""Exact top-k search, hard negatives and fill-in-the-middle against plain Python, with awkward tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from larkspur.llm import infill, negatives, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, query_id string, rank double, score string, id string, v string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, "y", "z", "w", "b") for r in rows], SCHEMA)


def whole(vector):
    """A vector's whole numbers, or None if it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def key(score, i):
    return (-score, i is None, i or 0)


def plain_top(rows, is_query, k):
    known = [(i, whole(v)) for i, v, _ in rows if whole(v) is not None]
    out = []
    for i, v in known:
        if i is not None and is_query(i):
            found = sorted((key(s, j), j, s) for j, w in known if j is None or j != i for s in [product(v, w)])
            out += [(i, r, j, s) for r, (_, j, s) in enumerate(sorted(found, key=lambda x: x[0])[:k], 1)]
    return sorted(out, key=str)


def plain_negatives(rows, is_anchor, k=5, n=5):
    known = [(i, whole(v), label) for i, v, label in rows if whole(v) is not None and label is not None]
    out = []
    for i, v, label in known:
        if i is None or not is_anchor(i):
            continue
        scored = [(key(product(v, w), j), product(v, w), j, other == label) for j, w, other in known if j is None or j != i]
        own = sorted((x for x in scored if x[3]), key=lambda x: x[0])[:k]
        for _, high, positive, _ in own:
            hard = sorted((x for x in scored if not x[3] and 80 * high <= 100 * x[1] <= 100 * high), key=lambda x: x[0])[:n]
            out += [(i, positive, r, j, high, s) for r, (_, s, j, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def clustered(rng, n, dims, centres):
    """Some groups of near vectors of different lengths, copies among them."""
    heart = rng.normal(size=(centres, dims))
    x = heart[rng.integers(centres, size=n)] + rng.normal(scale=0.2, size=(n, dims))
    x[rng.integers(n, size=n // 3)] = x[0]
    return (x * rng.uniform(0.2, 2, size=(n, 1))).astype(np.float32)


def awkward(rng):
    x = clustered(rng, 60, 11, 4)
    rows = [(i, [float(c) for c in v], int(rng.integers(3))) for i, v in enumerate(x)]
    rows += rows[:7]  # repeated rows, a query among them
    rows += [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan")] * 11, 1), (103, [float("inf")] + [0.0] * 10, 2), (110, [], 1), (120, [0.5, -0.25], 1), (None, rows[3][1], 1), (None, rows[3][1], 2), (130, [0.0] * 11, None), (-20, rows[5][1], 0)]
    return rows


@pytest.mark.parametrize("chunk, width, per", [(4096, 8, 256), (7, 3, 2)])
def test_top_k_of_awkward_rows(spark, chunk, width, per):
    rows = awkward(np.random.default_rng(3))
    df = frame(spark, rows).repartition(3)
    found = topk.top_k(df.where("vec_id % 5 = 0"), df, 4, width=width, chunk=chunk, per=per)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_top(rows, lambda i: i % 5 == 0, 4)


def test_top_k_in_passes_and_of_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(clustered(rng, 300, 24, 6))]
    df = frame(spark, rows).repartition(4)
    monkeypatch.setattr(vectors, "PASS_BYTES", 1)
    found = topk.top_k(df.where("vec_id % 9 = 0"), df, 5, per=8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_top(rows, lambda i: i % 9 == 0, 5)
    few = frame(spark, rows[:3])
    assert sorted((tuple(r) for r in topk.top_k(few, few, 5).collect()), key=str) == plain_top(rows[:3], lambda i: True, 5)


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(i, [float(2**20 + 3 * i), float(-(2**21)), float(i)], 0) for i in range(20)]
    df = frame(spark, rows)
    shape = vectors.measured(df.select(vectors.whole_numbers(df.embedding).alias("v")))
    assert shape.exact is np.int64 and shape.kind == "<i4"
    assert sorted((tuple(r) for r in topk.top_k(df, df, 2).collect()), key=str) == plain_top(rows, lambda i: True, 2)
    with pytest.raises(ValueError):
        topk.top_k(*[frame(spark, [(1, [1e30], 0)])] * 2)


def test_searches_of_empty_tables(spark):
    none = frame(spark, [])
    assert topk.top_k(none, none).count() == 0
    assert negatives.mine(none, none.vec_id % 2 == 0).count() == 0
    alone = frame(spark, [(0, [1.0, 2.0], 1), (2, None, 1), (4, [1.0, 2.0], None)])
    assert topk.top_k(alone.where("vec_id = 0"), alone.where("vec_id = 0")).count() == 0
    assert negatives.mine(alone, alone.vec_id % 2 == 0).count() == 0


@pytest.mark.parametrize("pivots, chunk, per", [(32, 2048, 256), (3, 5, 2)])
def test_negatives_of_awkward_rows(spark, pivots, chunk, per):
    rows = awkward(np.random.default_rng(7))
    df = frame(spark, rows).repartition(3)
    found = negatives.mine(df, df.vec_id % 5 == 0, pivots=pivots, chunk=chunk, per=per)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_by_several_rounds_read_parts_of_the_keys(spark):
    """Near groups: anchors are done before their radii reach the other groups' keys."""
    rng = np.random.default_rng(9)
    x = clustered(rng, 400, 16, 12)
    rows = [(i, [float(c) for c in v], int(rng.integers(2))) for i, v in enumerate(x)]
    df = frame(spark, rows).repartition(4)
    found = negatives.mine(df, df.vec_id % 10 == 0, chunk=16, per=8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_keys_are_sorted_and_complete(spark):
    rng = np.random.default_rng(11)
    df = frame(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(clustered(rng, 200, 8, 5))])
    rows = df.select(df.vec_id.alias("id"), df.label.cast("bigint").alias("label"), vectors.whole_numbers(df.embedding).alias("v"))
    shape = vectors.measured(rows)
    chunks = negatives.index(rows, shape, 6, 9).chunks.collect()
    assert sorted(i for c in chunks for i in c.ids) == list(range(200))
    spans = {}
    for c in chunks:
        dist = np.frombuffer(c.dists)
        assert len(dist) == len(c.ids) <= 9 and (np.diff(dist) >= 0).all() and (c.low, c.high) == (dist[0], dist[-1])
        spans.setdefault(c.pivot, []).append((c.low, c.high))
    for own in spans.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def plain_infill(doc_id, text, units=None):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    pieces = re.findall(f"(?as){units}|.", text) if units else list(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(pieces)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (pieces[:a], pieces[a:z], pieces[z:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "a", "ab\n", "\n\n", "ein Wort \U0001f600 und été", "x<P>y", "<M>", "<S", "P><S", "<<P", "z" * infill.RUN, "z" * (2 * infill.RUN), "\U0001f600" * (infill.RUN + 1),
    "some words, and  blanks \t here " * 900, "é" * 700, "\u0000\r\n  line ends",
]


def docs(spark, rows):
    names = "doc_id bigint, text string, n string, form string, output string, _doc string, _body string, _n_units string, cuts string, pos string"
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], names)


@pytest.mark.parametrize("pattern", [None, r"\S+\s*", r"[^\n]*\n"])
@pytest.mark.parametrize("few", [True, False])
def test_infill_of_awkward_texts(spark, monkeypatch, pattern, few):
    if not few:
        monkeypatch.setattr(infill, "BROADCAST_DOCS", 0)
    rows = [(17 * k + 1000 * r, t) for r in range(6) for k, t in enumerate(TEXTS)]
    rows += rows[:9] + [(None, "no identifier at all"), (None, "another one"), (34, "an identifier again")]
    found = infill.fill_in_middle(docs(spark, rows), pattern=pattern)
    made = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str)
    assert made == sorted(((i, t, *plain_infill(i, t, pattern)) for i, t in rows), key=str)
    assert {r[3] for r in made} == {"plain", "psm", "spm"}
    back = found.select("text", infill.restored(found.output, found.form).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_infill_of_an_empty_table(spark):
    found = infill.fill_in_middle(docs(spark, []))
    assert found.count() == 0 and {"n", "form", "output", "_doc"} <= set(found.columns)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.text(st.characters(exclude_categories=["Cs"]), max_size=40)), min_size=1, max_size=12))
def test_infill_of_any_texts(spark, rows):
    found = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string"))
    made = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str)
    assert made == sorted(((i, t, *plain_infill(i, t)) for i, t in rows), key=str)
