"""Token counts by a two-tier lookup on the map side.

Each text is cut into pre-tokens at the boundaries of the tokenizer's pattern and the lengths of their
encodings are added up. Lengths come from a table broadcast to all workers: hashes of pre-tokens, sorted, with
a byte for each length. What a table holds is found for a whole piece of the corpus at once; for pre-tokens it
lacks each worker asks the tokenizer library, through a cache. The table holds the pre-tokens that the
vocabulary itself has as entries, which are those frequent where it comes from, so its size doesn't depend on
the corpus, and no pre-token is counted or shuffled. The cache is emptied at a fixed size and keeps no long ones.

Defined cases: a null or empty text has no bytes and no tokens; equal rows give equal counts; an empty
table gives no rows; other columns are dropped; texts of any length are counted whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsense.functions.arrays import flat, pieces, tidy
from logsense.llm.bpe import slice_starts
from logsense.llm.substrings import range_hashes
from logsense.session import ship

#: Entries after which a worker empties its cache, and bytes from which pre-tokens aren't kept.
CACHE, LONG = 400_000, 64


def byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def frequent_lengths(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and number of tokens of all vocabulary entries that are whole pre-tokens."""
    tok, back, pattern = Tokenizer.from_file(path), byte_chars(), regex.compile(public_tokenizers.PATTERN)
    words = []
    for entry in tok.get_vocab(with_added_tokens=False):
        try:
            word = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(word):
            words.append(word)
    stop = np.cumsum([0, *(len(w.encode()) for w in words)])
    h = range_hashes(np.frombuffer("".join(words).encode(), np.uint8), stop[:-1], stop[1:])
    order = np.argsort(h)
    n = np.array([len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)], np.uint8)
    return h[order], n[order]


class Lengths(dict):
    """Bytes of a pre-token to number of tokens, by the library."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> int:
        n = len(self.tok.encode(word.decode(), add_special_tokens=False).ids)
        if len(word) < LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def token_numbers(data: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray], lengths: Lengths) -> np.ndarray:
    """Number of tokens of each text of a flat piece without added tokens."""
    if not len(data):
        return np.zeros(len(at) - 1, np.int64)
    start = slice_starts(data, at)
    stop = np.append(start[1:], len(data))
    h = range_hashes(data, start, stop)
    k = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    n = table[1][k].astype(np.int64)
    missed = np.flatnonzero(table[0][k] != h)
    buffer = data.tobytes()
    n[missed] = [lengths[buffer[a:b]] for a, b in zip(start[missed].tolist(), stop[missed].tolist(), strict=True)]
    upto = np.concatenate([[0], np.cumsum(n)])
    return np.diff(upto[np.searchsorted(start, at)])


def without_added(data: np.ndarray, at: np.ndarray, added: regex.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts without added tokens, each cut where one was, and the text that each part belongs to."""
    parts, owner = [], []
    for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        own = added.split(data[a:b].tobytes())
        parts += own
        owner += [k] * len(own)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), np.array(owner)


@functools.cache
def added_tokens(path: str) -> regex.Pattern | None:
    """Pattern of the strings that the tokenizer takes out of a text before anything else."""
    with open(path) as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path}: added tokens that look at their surroundings aren't supported")
    return regex.compile("|".join(regex.escape(t["content"]) for t in added).encode()) if added else None


_worker: dict[str, Lengths] = {}


def _lengths(path: str) -> Lengths:
    """This worker's cache, kept between its tasks."""
    if path not in _worker:
        _worker[path] = Lengths(path)
    return _worker[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, as the library's default encoding gives them."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(frequent_lengths(path))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, added, table = _lengths(path), added_tokens(path), shared.value
        for batch in batches:
            data, at = flat(batch.column("text"))
            n = np.zeros(len(at) - 1, np.int64)
            for i, j in pieces(at):
                own, cut = data[at[i] : at[j]], at[i : j + 1] - at[i]
                if added and added.search(own.tobytes()):
                    part, ends, owner = without_added(own, cut, added)
                    n[i:j] = np.bincount(owner, token_numbers(part, ends, table, lengths), j - i) + np.bincount(owner, minlength=j - i) - 1
                else:
                    n[i:j] = token_numbers(own, cut, table, lengths)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(counts), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
