"""Every stage of the pipeline on its own input, against plain Python."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from test_similar_sets import brute as groups_of
from test_substrings import brute as repeats_of

from logsense.llm import bpe
from logsense.session import checkpoint


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120 or doc_id % 3 = 0")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "repeated_substrings", "source_mix", "byte_bpe"]
    extra = spark.createDataFrame([(100_001, "12 34 !", "en", "src1", 7), (100_002, None, None, None, None)], docs.schema)

    a = checkpoint(stages["language_id"](spark, docs.unionByName(extra), sf))
    assert a.columns == names and not {100_001, 100_002} & {r.doc_id for r in a.collect()} and a.count() > 0.98 * docs.count()

    rows = [(r.doc_id, r.text) for r in a.collect()]
    b = checkpoint(stages["near_duplicates"](spark, a, sf))
    want = {c for k, n, c in groups_of(rows, 5, 80, 100) if n} | {k[1] for k, n, c in groups_of(rows, 5, 80, 100) if not n}
    assert b.columns == names and sorted(r.doc_id for r in b.collect()) == sorted(want)

    c = checkpoint(stages["repeated_substrings"](spark, b, sf))
    before = {r.doc_id: r.text for r in b.collect()}
    removed = {d: n for d, _, n, _, _ in repeats_of(list(before.items()))}
    after = {r.doc_id: r.text for r in c.collect()}
    assert c.columns == names and set(after) == set(before)
    assert all(after[d] == before[d] if not removed[d] else 0 <= len(before[d].encode()) - removed[d] - len(after[d].encode()) <= 6 * removed[d] // 50 for d in before)

    d = checkpoint(stages["source_mix"](spark, c, sf))
    size = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in c.collect()}
    taken, total = {}, sum(n for _, n in size.values())
    for r in d.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + size[r.doc_id][1]
        assert r.text == after[r.doc_id]
    assert d.columns == names and all(n <= 2 * size[k][1] for k, n in taken.items()) and abs(sum(taken.values()) - 1.5 * total) < 0.1 * total

    out = stages["byte_bpe"](spark, d, sf)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert out.count() == d.count()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(after[r.doc_id]) for r in out.limit(40).collect())
