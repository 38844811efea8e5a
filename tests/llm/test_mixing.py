"""The mix against its contract, and against a plain computation of the targets."""

import random

from logsense.llm import mixing
from logsense.session import checkpoint


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= set(over)


def docs_of(spark, seed=1, n=3000):
    rng = random.Random(seed)
    names = ["a", "B", "é", None, "z9", "hot"]
    rows = [(k, "w " * rng.choice([0, 1, 3, 40, 200, rng.randrange(400)]), "hot" if k % 3 == 0 else rng.choice(names), 7) for k in range(n)]
    rows += [(n, None, "a", 1), (n + 1, "word " * 20_000, "B", 1), (5, rows[5][1], rows[5][2], 7), (None, "x y z", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix(spark):
    docs = docs_of(spark)
    sized = checkpoint(mixing.sized(docs))
    out = mixing.mix_sizes(sized).collect()
    assert len(out) == docs.count() and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_sizes(sized).collect()), key=str)
    of = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in out:
        s = of[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        largest[s], target[s] = max(largest.get(s, 0), r.size), r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= largest[s]
    assert all(r.source_size == sizes[of[r.doc_id]] for r in out)


def test_longer_texts_are_likelier(spark):
    rows = [(k, "w " * (20 if k % 2 else 4000), "a" if k < 4000 else "b") for k in range(4400)]
    sized = checkpoint(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    out = [r for r in mixing.mix_sizes(sized, weights=(1, 9), share=0.4, most=1).collect() if r.doc_id < 4000]
    share = lambda n: sum(r.taken > 0 for r in out if r.size == n) / 2000
    assert share(4000) > 1.4 * share(20) > 0


def test_documents_and_empty(spark):
    docs = docs_of(spark, 4, 300)
    sized = checkpoint(mixing.sized(docs))
    whole = mixing.mix_documents(docs, sized)
    assert whole.columns == docs.columns
    want = sum(r.taken // r.size if r.size else 1 for r in mixing.mix_sizes(sized).collect())
    assert whole.count() == want
    assert mixing.mix_sizes(sized.limit(0)).count() == 0
