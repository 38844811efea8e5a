"""Substring removal against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from logsense.llm import batches, substrings


def brute(rows, length=50):
    least = {}
    key = lambda d: (d is None, d or 0)
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w not in least or key(d) < least[w]:
                least[w] = key(d)
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < key(d):
                gone[i : i + length] = True
        runs = int(np.sum(gone[1:] & ~gone[:-1]) + (gone[:1].sum())) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((-1 if d is None else d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "tion", "é", "ß", "日本", "a", "x" * 9]
    sentence = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = [sentence(k) for k in (8, 12, 30, 60)]
    rows = []
    for k in range(60):
        t = sentence(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t = t[:at] + s[a:] + t[at:]
        rows.append((k, t))
    rows += [(60, rows[3][1]), (61, None), (62, ""), (63, "ab" * 200), (64, "ab" * 90), (65, "z" * 500), (66, "z" * 70 + shared[2]), (5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (67, "q" * 49), (68, "q" * 50), (69, "q" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1 << 22, 2000])
def test_against_windows(spark, monkeypatch, size):
    monkeypatch.setattr(batches, "BATCH", size)
    monkeypatch.setattr(substrings, "REFINED", 300 if size < 5000 else 1 << 20)
    rows = corpus(size)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, bucket int")
    assert got(substrings.repeat_digests(docs)) == brute(rows)
    clean = substrings.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)


def test_empty(spark):
    assert substrings.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pointers():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 3000), np.zeros(60), rng.integers(97, 99, 90), np.full(200, 97)]).astype(np.uint8)
    data[1500:1700] = data[100:300]
    order, pointer = substrings.refine(data, 50)
    raw = data.tobytes()
    assert sorted(order.tolist()) == list(range(len(raw))) and (np.diff(pointer[order]) >= 0).all()
    at = np.arange(len(raw) - 49)
    p, seen = substrings.window_classes(data, at, 50), {}
    for i in at.tolist():
        assert seen.setdefault(raw[i : i + 50], p[i]) == p[i]
    assert len(set(seen.values())) == len(seen) < len(at)


def test_equal_hashes_are_compared():
    data = np.frombuffer(b"abcdefghij" * 3 + b"abcdefghiX", np.uint8)
    start = np.array([0, 10, 20, 30])
    lead, place = substrings.leads(data, start, start + 10, np.zeros(4, np.uint64), np.zeros(4, np.uint64), np.array([7, 5, 9, 6]))
    assert lead[place].tolist() == [1, 1, 1, 3]


def test_long_text_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 123, 1 << 20, np.uint8)).decode()
    rows = [(1, text), (2, "-" + text[1000:2000] + "+"), (3, text[5000:5040]), (4, text[-70:])]
    want = [(1, len(text), 0), (2, 1002, 1000), (3, 40, 0), (4, 70, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.repeat_digests(docs).collect()) == want


def test_names_and_cut_characters(spark):
    passage = "é" * 30 + "lorem ipsum dolor sit amet, consectetur" * 2
    docs = spark.createDataFrame([(1, passage, 1, 2), (2, "\ufffd©" + passage[1:] + "\ufffd", 1, 2)], "doc_id long, text string, `my col` int, `a.b` int")
    out = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert out[1].text == passage and out[2].text == "\ufffd\ufffd" and out[2]["my col"] == 1 and out[2]["a.b"] == 2


def test_windows_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(50, 77, 300)
    data = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
    for k in (k for k in range(0, 280, 3) if k // 9 == (k + 2) // 9):  # repeats
        a, n = int(sizes[:k].sum()), int(min(sizes[k], sizes[k + 2]))
        b = int(sizes[: k + 2].sum())
        data[b : b + n] = data[a : a + n]
    keys, ids = np.arange(300) // 9, rng.integers(0, 50, 300)
    want = substrings.repeated_windows(data, sizes, keys, ids, 50)
    for block in (1, 100, 5000):
        monkeypatch.setattr(substrings, "REFINED", block)
        assert (substrings.repeated_windows(data, sizes, keys, ids, 50) == want).all()
    h = substrings.range_hashes(data, np.arange(200), np.arange(200) + 60)
    assert (substrings.range_hashes(data, np.arange(200), np.arange(200) + 60, 7) == h).all()
    stop = np.cumsum(sizes)
    seen = [[(bytes(data[b - s + i : b - s + i + 50]), d) for i in range(s - 49)] for b, s, d in zip(stop, sizes, ids)]
    for k in range(300):
        least = {}
        for w, d in (x for j in range(300) if keys[j] == keys[k] for x in seen[j]):
            least[w] = min(d, least.get(w, d))
        for i, (w, d) in enumerate(seen[k]):
            assert bool(want[k] >> i & 1) == (least[w] < d)


def test_anchors_are_sought_in_small_blocks():
    """Arrays from 128 KB on are mapped anew by each step, which took most of the time; anchors don't depend on the blocks."""
    assert 8 * (substrings.BLOCK + 100) < 1 << 17
    data = np.random.default_rng(1).integers(97, 101, 40_000).astype(np.uint8)
    at = np.array([0, 10, 25_000, 40_000])
    found = []
    for block in (substrings.BLOCK, 1 << 18):
        s = substrings.Spans(substrings.Batch(0, np.arange(3), at, data, None), 50, 8, block)
        found.append([(w + k, key) for w, n, key in zip(s.first.tolist(), s.n_windows.tolist(), s.keys.tolist()) for k in range(n)])
    assert found[0] == found[1]
