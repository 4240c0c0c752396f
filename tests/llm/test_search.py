"""Whitening, top-k search and lexical search against brute force."""

import math
import random
import re

import numpy as np
import pytest

from idlens.llm import lexical, topk, whitening
from idlens.llm.queries import op11_whitening, op12_top_k, op13_lexical_search
from idlens.llm.vectors import quantised

VECTORS = "vec_id bigint, embedding array<float>, x int, ids string, block int, number int, rank int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], VECTORS).repartition(parts)


def odd_vectors():
    """Null, empty, short, null-holding and non-finite vectors, null and repeated ids, copies, ties."""
    rnd = np.random.default_rng(3)
    base = [[float(x) for x in v] for v in rnd.normal(size=(60, 6))]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(40)]
    return rows + [(None, base[1]), (3, base[3]), (7, base[8]), (300, None), (301, []), (302, [1.0]), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
                   (304, [float("nan")] * 6), (305, [float("inf")] + [0.0] * 5), (306, [-float("inf")] + [0.0] * 5), (307, [0.0] * 6), (308, [-0.0] * 6)]


def usable(rows, keep_null=True):
    out = []
    for i, v in rows:
        if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v) and (keep_null or i is not None):
            out.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    return out


def test_quantised_rows(spark):
    rows = odd_vectors()
    found = quantised(vectors(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, tuple(r.x)) for r in found), key=key) == sorted(usable(rows), key=key)


def check_whitening(rows, found, components=4):
    """`rows` are (id, whole numbers); `found` are collected result rows."""
    fit = np.array(sorted({x for _, x in rows}), float)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    centred = fit - fit.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    kept = min(components, fit.shape[1])
    assert len(found) == len(rows) * kept
    want = {}
    for _, x in rows:
        dev = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        want.setdefault(dev, []).append(x)
    sign = {}
    for r in found:
        assert r.n == n and r.deviation == r.deviation_exact and r.deviation in want
        j = r.component - 1
        assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
        plain = [(np.array(x) - fit.mean(0)) @ basis[:, j] / math.sqrt(values[j]) for x in want[r.deviation]]
        near = [p for p in plain if abs(abs(p) - abs(r.whitened)) < 1e-8]
        assert near
        if len(plain) == 1 and abs(r.whitened) > 1e-6:
            assert sign.setdefault(j, math.copysign(1, plain[0] * r.whitened)) == math.copysign(1, plain[0] * r.whitened)


def test_whitening_is_brute_force(spark):
    rows = odd_vectors()
    for values in (1 << 22, 7 * 6):  # one block a task, blocks of seven rows
        check_whitening(usable(rows), whitening.whiten(vectors(spark, rows), block_values=values).collect())


def test_whitening_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, tuple(math.floor(256 * c) for c in r.embedding)) for r in table.collect()]
    check_whitening(rows, op11_whitening(spark, sf_dir).collect())


def test_whitening_without_variance(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.explained) for r in flat) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 1.0), (2, 1, 1.0), (2, 2, 0.0), (2, 2, 0.0)]
    assert all(abs(r.whitened) == pytest.approx(1) for r in flat if r.component == 1)
    assert all(r.whitened is None for r in flat if r.component == 2)
    nothing = whitening.whiten(vectors(spark, []).limit(0))
    assert nothing.collect() == [] and nothing.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_deviations_are_exact_for_large_numbers():
    x = np.array([[1 << 40, -(1 << 41)], [5, 7]], np.int64)
    sums = [1 << 60, 123]
    want = [sum((10 ** 6 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 10 ** 6, sums) == [w if w < 10 ** 38 else None for w in want]


def brute_top(rows, k, every):
    out = []
    for own in sorted({i for i, _ in rows if i % every == 0}):
        asked = {x for i, x in rows if i == own}
        pairs = [(sum(a * b for a, b in zip(q, x)), i) for q in asked for i, x in rows if i != own]
        out += [(own, at + 1, i, s) for at, (s, i) in enumerate(sorted(pairs, key=lambda p: (-p[0], p[1]))[:k])]
    return out


@pytest.mark.parametrize("size", [17, None])
def test_top_k_is_brute_force(spark, size):
    rows = odd_vectors()
    found = topk.top_k(vectors(spark, rows), every=5, shard_rows=size).collect()
    assert sorted(tuple(r) for r in found) == brute_top(usable(rows, keep_null=False), 5, 5)


def test_top_k_with_few_rows(spark):
    assert topk.top_k(vectors(spark, [])).collect() == []
    assert topk.top_k(vectors(spark, [(0, [1.0])])).collect() == []
    assert [tuple(r) for r in topk.top_k(vectors(spark, [(0, [1.0]), (7, [0.5]), (8, [0.0])])).orderBy("rank").collect()] == [
        (0, 1, 7, 128 * 256), (0, 2, 8, 0)]


def test_top_k_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, tuple(math.floor(256 * c) for c in r.embedding)) for r in table.collect()]
    assert sorted(tuple(r) for r in op12_top_k(spark, sf_dir).collect()) == brute_top(rows, 5, 50)


def test_shard_stops_on_proof():
    """Rows near a query are found before all postings are read, whatever the scale of the numbers."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(20, 32))
    x = np.floor(256 * (centres[rnd.integers(0, 20, 3000)] + 0.3 * rnd.normal(size=(3000, 32)))).astype(np.int64)
    for scale in (1, 10 ** 7, 10 ** 15):
        shard = topk.Shard(np.arange(3000), x * scale)
        for own in (0, 50, 100):
            exact = [(sum(int(a) * int(b) for a, b in zip(x[own] * scale, row)), i) for i, row in enumerate((x * scale).tolist()) if i != own]
            want = [(i, min(s, (1 << 63) - 1)) for s, i in sorted(((min(s, (1 << 63) - 1), i) for s, i in exact), key=lambda p: (-p[0], p[1]))[:5]]
            assert shard.search(own, x[own] * scale) == want
        assert scale > 1 or shard.postings < 3 * x.size
        assert scale > 1 or shard.rescored < 3 * len(x) / 8


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k=50):
    split = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in docs]
    split = [(i, ws) for i, ws in split if ws]
    n, length = len(split), sum(len(ws) for _, ws in split)
    df = {}
    for _, ws in split:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(WORD.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, ws in split:
            m, score = 50 + (50 * len(ws) * n) // length, 0
            for w in terms.intersection(ws):
                tf = ws.count(w)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def lexical_docs():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(120)] + ["Éa", "日本", "X1"]
    pick = lambda n: " ".join(vocabulary[min(int(rnd.expovariate(0.05)), 122)] for _ in range(n))
    docs = [(i, pick(rnd.randrange(1, 60))) for i in range(150)] + [(500 + i, "w1 w2 common") for i in range(80)]
    docs += [(None, "w1 w2 common"), (None, None), (600, None), (601, ""), (602, " .,! "), (7, "w1 w2 common"), (603, pick(20_000)), (604, "É é日本 x1-X1_x1")]
    items = [(f"b{i}", pick(rnd.randrange(1, 90))) for i in range(12)] + [("rare", "Éa 日本"), ("common", "common w1"), ("none", None), ("empty", "?!"), (None, "w5 w7"),
                                                                        ("twice", "w3"), ("twice", "w4 w3"), ("absent", "zzz")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard_docs": 7, "block_terms": 40}])
def test_lexical_search_is_brute_force(spark, how):
    docs, items = lexical_docs()
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id bigint, text string, n int, terms int, item_id string").repartition(3)
    i = spark.createDataFrame([(a, t, "y") for a, t in items], "item_id string, text string, term string")
    found = lexical.rank_documents(d, i, k=20, **how).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: (str(r[0]), r[1])) == brute_ranks(docs, items, 20)


def test_lexical_search_on_awkward_and_empty_tables(spark, awkward, nothing):
    items = spark.createDataFrame([("a", "two words of text"), ("b", None)], "item_id string, text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    found = [tuple(r) for r in lexical.rank_documents(awkward, items).collect()]
    assert sorted(found, key=lambda r: (str(r[0]), r[1])) == brute_ranks(docs, [("a", "two words of text"), ("b", None)])
    assert lexical.rank_documents(nothing, items).collect() == []
    assert lexical.rank_documents(awkward, items.limit(0)).collect() == []


def test_lexical_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = [tuple(r) for r in op13_lexical_search(spark, sf_dir).collect()]
    assert sorted(found, key=lambda r: (str(r[0]), r[1])) == brute_ranks(docs, [(str(i), t) for i, t in items])


def test_masks_with_many_terms_and_early_stop():
    """Masks of over 64 terms group documents rightly, and not all documents are evaluated."""
    rnd = np.random.default_rng(1)
    held = rnd.random((2000, 90)) < 0.2
    held[:3] = True
    held[100:1000] = held[100]  # a large group of one mask
    ends = held.sum(1).cumsum()
    terms = np.concatenate([np.flatnonzero(r) for r in held]).astype(np.int32)
    times = np.ones(len(terms), np.int64)
    shard = lexical.Shard(np.arange(2000), np.zeros(2000, bool), np.full(2000, 100), ends, terms, times, 2000, 200_000)
    docs, mask, bits = shard.masks(np.arange(90))
    assert (bits[mask].astype(bool) == held[docs]).all() and len(bits) == len({tuple(r) for r in held.tolist()})
    best = lexical.Best(3)
    evaluated = lexical.search(shard, np.arange(90), np.ones(90, np.int64), best)
    assert sorted(best.rows[:, 1].tolist()) == [0, 1, 2] and evaluated < 1000  # the first 32 masks
