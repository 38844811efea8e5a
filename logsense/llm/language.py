"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every entry of the vocabulary. A word's probability is the sum over
all ways to cut it into entries, found by the forward algorithm; a text's is the product over its words,
and the languages' posterior under equal priors gives the prediction. The probabilities are learned by
expectation maximisation with the forward and backward sums, on word counts of a bounded sample.

Words are maximal runs of letters, in lower case, with a space before them as in the vocabulary. A word of
any length is summed over whole: the forward algorithm goes through it in blocks, carrying the sums that
entries across the border need, scaled against underflow.

Bounds of what is learned from (parameters): `sample` rows a language, about, of which the `most` most
frequent words of up to `longest` bytes count; MODEL_BYTES for the table of probabilities, whose size
is checked before it is broadcast.

Defined cases: a null text and a text without letters are `und` with score 0; a null lang teaches nothing;
rows with a null id aren't held out; without any labelled row everything is `und`; equal texts
get equal predictions; ties go to the first language by code point; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logsense.functions.arrays import flat, pieces, tidy
from logsense.llm.batches import quoted
from logsense.llm.bpe import read_ranks
from logsense.session import checkpoint, ship

#: Rows per language, about, that the probabilities are learned from; their most frequent words; bytes of a word.
SAMPLE, MOST, LONGEST = 500, 20_000, 64
ROUNDS, FLOOR, CACHE = 4, 1e-6, 100_000
#: Bytes of a word that the forward algorithm takes at once: sums stay within a double's range for so long.
BLOCK = 32
#: Largest table of probabilities that is broadcast.
MODEL_BYTES = 1 << 30
#: Probabilities are held times this to the power of the bytes covered, against underflow.
LIFT = 32.0
_MULT = np.uint64(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}+")
#: What an entry inside a word may look like: ASCII letters in lower case and any other bytes, maybe after the space.
IN_WORDS = re.compile(rb" ?[a-z\x80-\xff]*")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


class Pieces:
    """The vocabulary's entries by length, as sorted hashes with their numbers."""

    def __init__(self, entries: list[bytes]):
        self.n = len(entries)
        self.longest = max(map(len, entries), default=1)
        by_length: dict[int, list[int]] = {}
        for k, e in enumerate(entries):
            by_length.setdefault(len(e), []).append(k)
        self.by_length = {}
        for length, own in sorted(by_length.items()):
            hashes = self.hashed(np.frombuffer(b"".join(entries[k] for k in own), np.uint8).reshape(-1, length))
            order = np.argsort(hashes)
            self.by_length[length] = hashes[order], np.array(own, np.int32)[order]

    @staticmethod
    def hashed(chars: np.ndarray) -> np.ndarray:
        """One hash for each row of bytes."""
        h = np.zeros(len(chars), np.uint64)
        for c in chars.T:
            h = Pieces.longer(h, c)
        return h

    @staticmethod
    def longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Hashes of strings, each a byte longer."""
        h = (h ^ (c + np.uint64(1))) * _MULT
        return h ^ (h >> np.uint64(29))

    def spans(self, chars: np.ndarray, first: int = 0) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """End and length to the rows that have an entry there, and the entries; ends after `first`."""
        m, width = chars.shape
        out = {}
        for i in range(width):
            h = np.zeros(m, np.uint64)
            for length in range(1, min(self.longest, width - i) + 1):
                h = self.longer(h, chars[:, i + length - 1])
                if i + length > first and length in self.by_length:
                    hashes, numbers = self.by_length[length]
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    rows = np.flatnonzero(hashes[at] == h)
                    if len(rows):
                        out[i + length, length] = rows, numbers[at[rows]]
        return out


def by_width(words: list[bytes], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length each: their places in the list, and their bytes as rows."""
    lengths = np.array([len(w) for w in words])
    for width in np.unique(lengths):
        own = np.flatnonzero(lengths == width)
        for k in range(0, len(own), most):
            part = own[k : k + most]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, width)


def forward(spans: dict, sums: np.ndarray, first: int, prob: np.ndarray) -> None:
    """Fill the sums over segmentations of each row's prefixes, (width + 1, rows, languages), lifted, after `first`."""
    for end, length in sorted(spans):
        rows, k = spans[end, length]
        if length <= end and end > first:
            sums[end, rows] += sums[end - length, rows] * prob[k] * LIFT**length


def word_scores(words: list[bytes], pieces_: Pieces, prob: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Log probability of each word in each language; prob has a last row of zeros."""
    out = np.zeros((len(words), prob.shape[1]))
    back = pieces_.longest
    for at, chars in by_width(words):
        m, width = chars.shape
        sums, scale = np.ones((1, m, prob.shape[1])), np.zeros((m, prob.shape[1]))
        for start in range(0, width, block):
            own = chars[:, start - (len(sums) - 1) : start + block]  # with the bytes that the sums carried over end at
            before = len(sums) - 1
            sums = np.concatenate([sums, np.zeros((own.shape[1] - before, *sums.shape[1:]))])
            forward(pieces_.spans(own, before), sums, before, prob)
            sums = sums[-(back + 1) :]
            most = sums.max(0)
            with np.errstate(divide="ignore"):
                scale += np.log(most)
            sums = sums / np.where(most > 0, most, 1)
        with np.errstate(divide="ignore"):
            out[at] = np.log(sums[-1]) + scale - width * np.log(LIFT)
    return out


def learn(words: list[bytes], counts: np.ndarray, entries: list[bytes], rounds: int = ROUNDS) -> np.ndarray:
    """Probability of each entry in each language (and a last row of zeros) from counts (words, languages)."""
    own, n = Pieces(entries), len(entries)
    prob = np.vstack([np.full((n, counts.shape[1]), 1.0 / n), np.zeros((1, counts.shape[1]))])
    cut = [(at, chars, own.spans(chars)) for at, chars in by_width(words)]
    for _ in range(rounds):
        expected = np.zeros_like(prob)
        for at, chars, spans in cut:
            m, width = chars.shape
            sums = np.zeros((width + 1, m, counts.shape[1]))
            sums[0] = 1
            forward(spans, sums, 0, prob)
            back = np.zeros_like(sums)
            back[width] = counts[at] / sums[width]
            used, how_often = [], []
            for end, length in sorted(spans, reverse=True):
                rows, k = spans[end, length]
                p = prob[k] * LIFT**length * back[end, rows]
                back[end - length, rows] += p
                used.append(k)
                how_often.append(sums[end - length, rows] * p)
            k, use = np.concatenate(used), np.concatenate(how_often)
            for c in range(use.shape[1]):
                expected[:, c] += np.bincount(k, use[:, c], n + 1)
        expected[n] = 0
        prob = (expected + 0.02) / (expected.sum(0) + 0.02 * n)
        prob[:n] = np.maximum(prob[:n], FLOOR)
        prob[n] = 0
    return prob


def spaced(word: str) -> bytes:
    """A word's bytes with a space before them."""
    return b" " + word.encode()


def train(docs: DataFrame, path: str, sample: int = SAMPLE, most: int = MOST, longest: int = LONGEST) -> tuple[list[str], np.ndarray, list[bytes]]:
    """Languages, probabilities and entries, from the words of about `sample` rows a language that aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 2)).select("doc_id", "text", "lang")
    entries = sorted(e for e in read_ranks(path) if IN_WORDS.fullmatch(e))  # no other occurs in a word
    n = checkpoint(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if (m := n.count()) * 8 * (len(entries) + 1) > MODEL_BYTES:
        raise ValueError(f"the model of {m} languages is larger than {MODEL_BYTES} bytes")
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    chosen = labelled.join(F.broadcast(n.select(F.col("lang").alias("l"), "n")), F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    words = words.where(F.octet_length("word") < longest).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    rows = words.withColumn("rank", rank).where(F.col("rank") <= most).toPandas()  # at most `most` a language
    langs = sorted(rows["lang"].unique())
    index: dict[bytes, int] = {}
    lang_no = {x: k for k, x in enumerate(langs)}
    i = [index.setdefault(spaced(w), len(index)) for w in rows["word"]]
    counts = np.zeros((len(index), len(langs)))
    if i:
        np.add.at(counts, (i, [lang_no[x] for x in rows["lang"]]), rows["n"].to_numpy())
    return langs, learn(list(index), counts, entries), entries


class Scores(dict):
    """Word to its row in a table of scores; keeps the rows to be computed."""

    def __init__(self, pieces_: Pieces, prob: np.ndarray):
        super().__init__()
        self.pieces, self.prob, self.todo, self.n = pieces_, prob, [], 0
        self.table = np.zeros((0, prob.shape[1]))

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.todo.append(spaced(word))
        return k

    def rows(self) -> np.ndarray:
        """The table with a row for every word asked for."""
        if self.todo:
            if len(self) > len(self.table):
                self.table = np.concatenate([self.table[: self.n], np.zeros((len(self) * 2 - self.n, self.table.shape[1]))])
            self.table[self.n : len(self)] = word_scores(self.todo, self.pieces, self.prob)
            self.n, self.todo = len(self), []
        return self.table

    def trim(self) -> None:
        """Start anew beyond a fixed size."""
        if len(self) > CACHE:
            self.clear()
            self.n = 0


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, list[bytes]], with_text: bool = True) -> DataFrame:
    """Per row of docs: __row (all but the text), text, if asked for, lang_pred and score. A text goes to the worker once."""
    spark = docs.sparkSession
    ship(spark)
    langs, prob, entries = model
    shared = spark.sparkContext.broadcast((langs, prob, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob, entries = shared.value
        scores = Scores(Pieces(entries), prob)
        find, get = LETTERS.findall, scores.__getitem__
        for batch in batches:
            data, at = flat(batch.column("text"))
            for i, j in pieces(at):
                best, score = [], []
                rows = [np.array(list(map(get, find(data[at[k] : at[k + 1]].tobytes().decode().lower()))), np.int64) for k in range(i, j)]
                table = scores.rows()
                for r in rows:
                    if not len(r) or not langs:
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = table[r].sum(0)
                    p = np.exp(total - total.max())
                    best.append(langs[int(p.argmax())])
                    score.append(float(p.max() / p.sum()))
                scores.trim()
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
            own = None
            del batch, data  # before the next batch is read

    others = [c for c in docs.columns if c != "text"] or docs.columns
    names = ["__row", "text"] if with_text else ["__row"]
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("__row"), F.col("text").cast("string").alias("text"))
    kind = T.StructType().add("__row", rows.schema["__row"].dataType)
    kind = (kind.add("text", "string") if with_text else kind).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(tidy(run), kind)


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    x = identify(docs.select("doc_id", "text"), model, with_text=False)
    return x.select("__row.doc_id", (remainder(F.col("__row.doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """The documents with letters whose language is likelier than `least`, with their own columns."""
    x = identify(docs, model)
    return x.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*[(F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns])
