"""Language identification: forward sums against enumeration, held-out accuracy, odd rows."""

import itertools
import math
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P

from logsense.llm import language

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def enumerated(word, entries, p):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        q = 1.0
        for a, b in itertools.pairwise(at):
            q *= p[entries.index(word[a:b])] if word[a:b] in entries else 0.0
        total += q
    return total


def test_forward_sums():
    entries = [b"a", b"b", b" ", b"ab", b" a", b"aba", b"ba"]
    rng = np.random.default_rng(1)
    prob = np.vstack([rng.dirichlet(np.ones(len(entries)), 2).T, np.zeros((1, 2))])
    words = [b" abab", b" a", b" ba", b" aabab", b"b", b" abababbaabab"]
    for block in (1, 2, 3, 32):
        got = language.word_scores(words, language.Pieces(entries), prob, block)
        for w, row in zip(words, got, strict=True):
            assert np.allclose(row, [np.log(enumerated(w, entries, prob[:, c])) for c in range(2)])


def test_long_words_and_entries():
    """A word of thousands of bytes, and an entry of 100, against sums in exact fractions."""
    entries = [b"a", b"b", b"ab", b"ba" * 50, b"aba"]
    p = [Fraction(k, 16) for k in (3, 4, 5, 1, 3)]
    prob = np.array([[float(x)] for x in p] + [[0.0]])
    rng = np.random.default_rng(5)
    for n in (300, 3000):
        word = bytes(rng.integers(97, 99, n, np.uint8)) + b"ba" * 120
        sums = [Fraction(1)]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[end - len(e)] * x for e, x in zip(entries, p, strict=True) if word[:end].endswith(e)))
        exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
        for block in (7, 32):
            assert np.isclose(language.word_scores([word], language.Pieces(entries), prob, block)[0, 0], exact)


def test_no_cut_of_words():
    """Words of over 64 bytes aren't the product of their parts."""
    own = language.Pieces(entries := sorted(e for e in language.read_ranks(PATH) if language.IN_WORDS.fullmatch(e)))
    prob = np.vstack([np.random.default_rng(2).dirichlet(np.ones(len(entries)), 2).T, np.zeros((1, 2))])
    word = language.spaced("donaudampfschifffahrtsgesellschaft" * 5)
    whole, parts = language.word_scores([word], own, prob), language.word_scores([word[i : i + 64] for i in range(0, len(word), 64)], own, prob)
    assert own.longest > 16 and (whole > parts.sum(0)).all()


def test_learning_raises_likelihood():
    entries = [bytes([c]) for c in range(97, 123)] + [b" ", b" th", b"the", b" the", b"er"]
    words, counts = [b" the", b" other", b" there", b" water"], np.array([[50.0], [9], [7], [3]])
    score = [float((language.word_scores(words, language.Pieces(entries), language.learn(words, counts, entries, r)) * counts).sum()) for r in (0, 1, 2, 4)]
    assert score == sorted(score)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34 !?", "en", "s", 1), (-3, "", None, None, 0), (-4, "z" * 100_000, "en", "s", 1)], docs.schema)
    got = {r.doc_id: r for r in language.predict(docs.unionByName(odd), language.train(docs, PATH, sample=150)).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in lang)
    assert sum(got[d].lang_pred == lang[d] for d in held) > 0.95 * len(held)
    assert [(got[d].lang_pred, got[d].score) for d in (-1, -2, -3)] == [("und", 0.0)] * 3 and 0 <= got[-4].score <= 1


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None, "extra", 1)], "doc_id long, text string, lang string, score string, `my col` int")
    model = language.train(docs, PATH)
    assert [tuple(r) for r in language.predict(docs, model).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    assert language.predict(docs.limit(0), model).count() == 0 and language.known(docs, model).columns == docs.columns


def test_text_goes_once(spark):
    """A worker gets each text in one column, gives it back only if asked to, and rows stay as they were."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs, PATH, sample=100)
    x = language.identify(docs, model)
    assert "text" not in x.schema["__row"].dataType.names and "text" not in language.identify(docs, model, with_text=False).columns
    rows = [tuple(r) for r in language.known(docs, model).collect()]
    assert len(rows) > 0.98 * docs.count() and set(rows) <= {tuple(r) for r in docs.collect()}
