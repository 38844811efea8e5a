"""Token counts against the tokenizers library."""

import public_tokenizers as P
from tokenizers import Tokenizer

from logsense.llm.token_counts import count_tokens

PATH = P.path("byte_bpe_50k.json")


def test_counts(spark):
    texts = ["", "hello world", "it's  'tis\n\n ok's", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endof text|>", "日本語 é x", "word " * 5000, "\x1c x\x85y", None]
    docs = spark.createDataFrame([(k, t, "w") for k, t in enumerate(texts)] + [(1, "hello world", "w")], "doc_id long, text string, n_tokens string")
    tok = Tokenizer.from_file(PATH)
    got = count_tokens(docs, PATH).toPandas().sort_values("doc_id")
    want = {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == want and len(got) == len(texts) + 1
    assert dict(zip(got.doc_id, got.n_bytes, strict=True)) == {k: len((t or "").encode()) for k, t in enumerate(texts)}
    assert got.set_index("doc_id").over_limit.loc[7] and not got.set_index("doc_id").over_limit.loc[9]
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    got = count_tokens(docs, PATH).toPandas().set_index("doc_id").n_tokens
    assert all(got[k] == len(tok.encode(t, add_special_tokens=False).ids) for k, t in texts.items())
