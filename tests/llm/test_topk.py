"""Exact top-k against all pairs, with ties, odd rows and several blocks."""

import math

import numpy as np

from logsense.llm import topk


def brute(rows, k, every):
    good = [(n, i, [math.floor(64 * float(v)) for v in x]) for n, (i, x) in enumerate(rows) if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for m, q, x in good:
        if q is None or q % every:
            continue
        score = lambda y: min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        scored = sorted((-score(y), j is None, j or 0) for n, j, y in good if n != m and len(y) == len(x))
        out += [(q, r + 1, -1 if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, -1 if r.vec_id is None else r.vec_id, r.score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 4)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(v)) for v in x]) for i, x in enumerate(rng.normal(0, 0.1, (200, 8)))]
    rows += [(1000 + k, rows[40][1]) for k in range(30)]  # ties
    rows += [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [0.0] * 8), (2100, [0.5, 0.5]), (2101, [0.1, 0.2]), (-20, rows[3][1]), (None, rows[0][1])]
    assert got(topk.top_k(frame(spark, rows), 5, 20)) == brute(rows, 5, 20)


def test_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(v)) for v in x]) for i, x in enumerate(rng.normal(0, 0.3, (60, 4)))]
    best = max((r for r in rows if r[0] % 20), key=lambda r: sum(a * b for a, b in zip(r[1], rows[20][1])))
    rows += [(i, x) for i, x in rows if i < 20 or i > 40]
    rows += [best] * 5 + [(40, rows[3][1]), (7, rows[8][1])]  # the same ids with other vectors
    rows += [(None, [2 * v for v in rows[20][1]])] * 2 + [(None, best[1])]
    for size in (8192, 20):
        monkeypatch.setattr(topk, "CANDIDATES", size)
        monkeypatch.setattr(topk, "QUERIES_AT_ONCE", size // 8)
        assert got(topk.top_k(frame(spark, rows), 5, 20)) == brute(rows, 5, 20)


def test_large_values_and_few_rows(spark):
    rows = [(0, [3e6, -1.0]), (1, [2e6, 5.0]), (20, [1.0, 1.0])]
    assert got(topk.top_k(frame(spark, rows), 20, 20)) == brute(rows, 20, 20)
    rows += [(2, [float(np.float32(1e30)), 0.0]), (3, [float(np.float32(-1e30)), 0.0]), (4, [float(np.float32(2e30)), 0.0])]
    assert got(topk.top_k(frame(spark, rows), 4, 20)) == brute(rows, 4, 20)
    assert topk.top_k(frame(spark, []), 20, 20).count() == 0


def test_search_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-5, 6, (4000, 3)).astype(np.float32)
    rows[7] = [60, 60, 60]
    block = topk.Block(np.arange(4000), np.zeros(4000, bool), rows, np.argsort(rows, axis=0, kind="stable").T)
    query, none = np.array([9, 9, 9], np.float32), np.zeros(0, np.int64)
    found, scores = block.search(query, none, 1)
    assert found.tolist() == [7] and scores.tolist() == [1620] and block.met < 400
    found, scores = block.search(query, none, 20, least=1000)
    assert found.tolist() == [7] and block.met < 400
