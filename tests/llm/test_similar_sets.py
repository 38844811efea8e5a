"""The n-gram Jaccard join against all pairs of small tables."""

import random
import re

import numpy as np
import pytest

from logsense.llm import batches, similar_sets


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d is None, d or 0), len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=25):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(60)] + ["é", "the", "OF"]
    rows, d = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((d, " ".join(t)))
            d += 1
        base = t  # a chain
    common = " ".join(rng.choice(words) for _ in range(30))
    rows += [(d + k, common + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 50)))) for k in range(30)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "a b c d"), (9007, "a b c d"), (3, rows[0][1]), (3, rows[0][1]), (None, rows[5][1]), (None, "only null"), (9008, rows[7][1].lower())]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


@pytest.mark.parametrize(("size", "group", "hot"), [(1 << 22, 1 << 20, similar_sets.HOT), (3000, 150, 3)])
def test_against_all_pairs(spark, monkeypatch, size, group, hot):
    """Also with lists too short for many grams, and groups of few grams."""
    monkeypatch.setattr(batches, "BATCH", size)
    rows = corpus(size)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    assert got(similar_sets.link_groups(docs, 4, 85, 100, group, hot)) == brute(rows, 4, 85, 100)


def test_one_of_each(spark):
    rows = corpus(11, groups=12)
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, row string")
    kept = similar_sets.one_of_each(docs)
    want = brute(rows, 5, 80, 100)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    grouped = {c for k, n, c in want if n}
    assert sorted(i for i in ids if i is not None and i < 9000 or i in grouped) == sorted(c for c in grouped if c >= 0)
    assert {9000, 9001, 9002} <= set(ids)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar_sets.link_groups(docs).count() == 0


def test_exact_links_from_similar_answers():
    rng = np.random.default_rng(0)
    rule = similar_sets.Rule(4, 85, 100)
    base = rng.choice(10**6, 200, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.05], rng.choice(10**6, rng.integers(0, 12))])).astype(np.uint64) for _ in range(40)]
    sets += [np.unique(rng.choice(10**6, 150)).astype(np.uint64) for _ in range(5)]
    at = np.cumsum([0, *map(len, sets)])
    roots = similar_sets.exact_links(np.concatenate(sets), at, rule)
    found = similar_sets.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if rule.links(both, len(sets[i]), len(sets[j])):
                found.join(i, j)
    assert (roots == found.roots()).all()


def test_bitmaps_never_reject():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, k, np.uint64)) for k in (3, 300, 500, 540, 1000, 1100, 4000)]
    sets += [np.unique(np.concatenate([x[len(x) // 10 :], rng.integers(0, 1 << 62, len(x) // 12, np.uint64)])) for x in sets]
    at = np.cumsum([0, *map(len, sets)])
    docs = np.arange(len(sets))
    n = np.diff(at)
    maps = similar_sets.Maps(similar_sets.bitmaps(np.concatenate(sets), at, docs).view(np.uint64), n, docs)
    for i in docs:
        for j in docs:
            apart = len(np.setxor1d(sets[i], sets[j]))
            unlike = int(maps.unlike(np.array([i]), np.array([j]))[0])
            assert unlike <= apart and (unlike == 0) <= (apart == 0 or abs(maps.level[i] - maps.level[j]) > 1)
