"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random
import weakref
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from logsense.functions import arrays
from logsense.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = [
    "", " ", "  ", "a", "'", "'s", "don't stop", "it's 's 'sx ''s !'s", "  'tis", "x'll'll've're'm'd'T", "a\n\n b\n", "\t\tx  y ", "tail   ", "\r\n\r\n",
    "naïve café — 日本語 123四五", "́̂", "🙂🙃 ok", "1'2'3's", "' s", " '", " 's", "  's", "\n's", "x  y", "<|endoftext|>", "a" * 500, "ab" * 300, "!" * 100 + "?" * 77, "\x1c\x1f x\x85y", "'r", "'re", "'rE", "'l", "'ll",
]


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    got = bpe.encode_texts(np.frombuffer(b"".join(raw), np.uint8), at, bpe._merged(PATH).__getitem__)
    return [np.frombuffer(x, "<u4").tolist() for x in got]


def test_hard_texts(own):
    assert ids_of(HARD) == [own.encode_ordinary(t) for t in HARD]


def test_random_texts(own):
    rng = random.Random(5)
    alphabet = list("ab'strevmld S T\n\t  '!?12é日  🙂") + ["'re", "'ll", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 200))) for _ in range(600)]
    assert ids_of(texts) == [own.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=40), max_size=4))
def test_round_trip(texts):
    for t, ids in zip(texts, ids_of(texts), strict=True):
        raw = np.array(ids, "<u4").tobytes()
        (offsets,) = bpe.token_offsets([raw], bpe.vocabulary(PATH)[2])
        assert bpe.decode_ids(raw, offsets, len(t.encode()), PATH) == t.encode()


def test_decoding_goes_by_offsets():
    raw = np.array([64, 65, 66], "<u4").tobytes()  # one byte each
    assert bpe.decode_ids(raw, np.array([2, 0, 1], "<u4").tobytes(), 3, PATH) == bpe.decode_ids(np.array([65, 66, 64], "<u4").tobytes(), np.array([0, 1, 2], "<u4").tobytes(), 3, PATH)
    with pytest.raises(ValueError, match="belong together"):
        bpe.decode_ids(raw, np.array([0, 1, 2], "<u4").tobytes(), 4, PATH)


def test_frames(spark, own):
    rows = [(k, t, "x") for k, t in enumerate(HARD)] + [(99, None, None), (0, HARD[0], "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, PATH).toPandas()
    assert len(out) == len(rows)
    for (_, t, _), ids, offsets in zip(rows, out["ids"], out["offsets"], strict=True):
        want = own.encode_ordinary(t or "")
        assert np.frombuffer(ids, "<u4").tolist() == want
        raw, at = (t or "").encode(), np.frombuffer(offsets, "<u4").tolist()
        assert b"".join(raw[a:b] for a, b in zip(at, [*at, len(raw)][1:], strict=True)) == raw
    d = bpe.digests(bpe.encode(docs, PATH), PATH).where("doc_id = 8").first()
    assert d.decoded_sha256 == hashlib.sha256(HARD[8].encode()).hexdigest() and d.n_tokens == len(own.encode_ordinary(HARD[8]))
    assert bpe.digests(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_round_trip_takes_one_worker(spark):
    docs = spark.createDataFrame(list(enumerate([*HARD, None])), "doc_id long, text string")
    x = bpe.round_trip(docs, PATH)
    assert x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(bpe.counted(x).collect()) == sorted(bpe.digests(bpe.encode(docs, PATH), PATH).collect())


def test_cache_lasts_until_another_task():
    """A worker that goes on with other work holds no vocabulary."""
    held = weakref.ref(bpe._merged(PATH))
    assert list(arrays.tidy(iter, "bpe")(iter([1]))) == [1] and bpe._merged(PATH) is held()
    list(arrays.tidy(iter)(iter([])))
    assert held() is None


def test_worker_gives_memory_back(monkeypatch):
    """A task's function, as it arrives at a worker, trims that worker's heap, not the driver's."""
    sent = [cloudpickle.dumps(arrays.tidy(iter)), cloudpickle.dumps(arrays.tidy_group(len))]
    arrays.lean()
    calls = []
    monkeypatch.setattr(arrays, "_libc", SimpleNamespace(malloc_trim=calls.append))
    list(cloudpickle.loads(sent[0])(iter([])))
    assert calls == [0]
    cloudpickle.loads(sent[1])([])
    assert calls == [0, 0]
