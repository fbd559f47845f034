"""Whitening and top-k search against plain numpy and Python, with odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from braidlex.llm import topk_search, whitening
from braidlex.llm.vectors import LONG_MAX

SCHEMA = "vec_id long, embedding array<float>, n long, component int, rank int, x string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA).repartition(parts)


def vectors(n=300, width=6, seed=1):
    r = random.Random(seed)
    out = [(i, [float(np.float32(r.gauss(0.5, 0.3 * (d + 1)))) for d in range(width)]) for i in range(n)]
    hot = out[7][1]
    out += [(n + i, hot) for i in range(120)]  # equal vectors under many ids
    out += [(None, out[3][1]), (None, hot), out[50], out[50], (7, out[9][1]), (100, out[9][1])]  # without id, repeated, an id with two vectors
    out += [(1000, None), (1050, [NAN] * width), (1100, [None] + [0.0] * (width - 1)), (1150, [INF] * width), (1200, []), (1250, [1.0]), (1300, [1.0]), (1301, [2.0])]
    return out


def whole(v):
    return [math.floor(256 * c) for c in v]


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [8192, 7])
def test_whitening(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = vectors()
    got = whitening.whiten(table(spark, rows), 4).collect()
    kept = [(i, whole(v)) for i, v in rows if good(v) and len(v) == 6]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    want = sorted((str(i), c + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs((np.array(x) - fit.mean(axis=0)) @ axes[:, c]) / values[c] ** 0.5) for i, x in kept for c in range(4))
    have = sorted((str(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert np.allclose([w[3] for w in want], [h[3] for h in have], atol=1e-9)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    signs = {c: {np.sign(r.whitened * ((np.array(x) - fit.mean(axis=0)) @ axes[:, c - 1])) for r, x in [(r, dict((i, x) for i, x in kept if i not in (7, 50, 100, None)).get(r.vec_id)) for r in got if r.component == c] if x and abs(r.whitened) > 1e-6} for c in range(1, 5)}
    assert all(len(s) == 1 for s in signs.values())


def test_moments_merge_in_any_order():
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (500, 5)) + 10**9  # an offset that would cost all digits if squares were summed first
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 2, 50, 333])] + [whitening.Moments.none(5)]
    for order in (parts, parts[::-1]):
        total = whitening.Moments.none(5)
        for part in order:
            total = total.merged(part)
        assert total.n == 500 and total.sums == [int(s) for s in x.sum(axis=0)]
        assert np.allclose(total.scatter / 500, np.cov((x - 10**9).T, bias=True), rtol=1e-8)


def test_whitening_without_variance(spark):
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in same] == [(None, 0, 0.0, 0.0)] * 4
    flat = whitening.whiten(table(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    huge = whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()
    assert {r.deviation for r in huge} == {LONG_MAX}
    for rows in ([], [(1, None), (2, []), (3, [NAN])]):
        assert whitening.whiten(table(spark, rows)).count() == 0


def searched(rows, k, every):
    out = []
    distinct = {(i, tuple(whole(v))) for i, v in rows if good(v)}
    for q, x in distinct:
        if q is None or q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in distinct if i != q and len(x) == len(y)]
        out += [(q, rank + 1, None if nameless else i, -s) for rank, (s, nameless, i) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("k,tile,block,sums", [(5, 65_536, 8192, 2_000_000), (5, 40, 3, 100), (1, 90, 2, 1), (700, 100, 4, 1000)])
def test_search(spark, monkeypatch, k, tile, block, sums):
    for name, value in {"TILE_ROWS": tile, "LEAST_TILE": tile, "BLOCK_QUERIES": block, "CHUNK_SUMS": sums}.items():
        monkeypatch.setattr(topk_search, name, value)
    rows = vectors()
    got = sorted(str(tuple(r)) for r in topk_search.search(table(spark, rows), k, 50).collect())
    assert got == searched(rows, k, 50)


@pytest.mark.parametrize("scale", [256, 1 << 20, 1 << 40])
def test_search_in_every_number_type(spark, monkeypatch, scale):
    monkeypatch.setattr(topk_search, "LEAST_TILE", 30)
    rows = [(i, v) for i, v in vectors(60, 9, 4) if good(v) and len(v) == 9]
    bound = max(abs(math.floor(scale * c)) for _, v in rows for c in v) ** 2 * 9 * 4
    assert topk_search.exact_type(bound) is {256: np.float64 if bound >= 1 << 24 else np.float32, 1 << 20: np.float64, 1 << 40: object}[scale]
    exact = {(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows}
    want = []
    for q, x in exact:
        if q is not None and q % 10 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in exact if i != q]
            want += [(q, r + 1, None if no else i, min(max(-s, -(1 << 63)), LONG_MAX)) for r, (s, no, i) in enumerate(sorted(scores)[:3])]
    got = topk_search.search(table(spark, rows), 3, 10, scale=scale).collect()
    if scale < 1 << 40:
        assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    else:  # beyond a long the nearest one is given
        assert sorted((r.query_id, r["rank"], r.score) for r in got) == sorted((q, r, s) for q, r, _, s in want)


def test_search_sql_and_empty(spark):
    rows = [(i, v) for i, v in vectors() if i is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(str(tuple(r)) for r in con.sql(topk_search.search_sql()).fetchall()) == searched(rows, 5, 50)
    assert topk_search.search(table(spark, [])).count() == 0
    assert topk_search.search(table(spark, [(50, [1.0])])).count() == 0


def test_the_threshold_prunes():
    """Phases 2 and 3 sum up a part of the candidates only, and never loses one of the best."""
    r = np.random.default_rng(5)
    x, y = r.integers(-150, 150, (20, 64)).astype(np.float32), r.integers(-150, 150, (5000, 64)).astype(np.float32)
    entries = [x[:, a:b] @ y[:, a:b].T for a, b in topk_search.edges(64)]
    sums = sum(entries)
    cutoff = np.sort(sums, axis=1)[:, -5]
    for q, places in enumerate(topk_search.sufficient(entries, cutoff)):
        assert set(np.flatnonzero(sums[q] >= cutoff[q])) <= set(places) and len(places) < 2500
