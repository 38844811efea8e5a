"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Every code point becomes a symbol by a class table (letter, number, blank, other) and a look at its next
neighbours. An automaton over the symbols says where pre-tokens begin. Its transition functions form a
small monoid, whose elements are numbered; prefix products over a whole piece of the corpus come from one
blocked scan with a multiplication table, and a text's first symbol is a constant function, so texts
don't touch. The slices between boundaries go through a cache of merged pairs.

Defined cases: a null or empty text has no ids; equal texts give equal ids; an empty table gives no rows;
other columns are dropped; texts of up to 4 GB are encoded whole, and long slices are merged with a heap. Tokens
keep their offsets, and decoding puts their bytes there.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsense.functions.arrays import binaries, flat, kept, pieces, tidy
from logsense.session import ship

#: Entries after which a worker empties its cache of merged slices.
CACHE = 200_000
#: Bytes of text, or of ids, that one batch of results covers.
OUT = 1 << 20
#: Slices of a text cut at once, and tokens of a text decoded at once.
BLOCK = 1 << 16
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# Symbols: classes of code points with what matters of their right neighbours.
SYM_L, SYM_N, SYM_O, SYM_SHORT, SYM_LONG, SYM_BLANKS, SYM_LAST_SPACE, SYM_LAST_BLANK = range(8)
# States: what the pre-token under way is; FRESH: none, LEAD: a space that the next run joins,
# ONE and TWO: a contraction that still takes so many letters.
FRESH, IN_L, IN_N, IN_O, IN_BLANKS, LEAD, ONE, TWO = range(8)
# The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for start in range(0, 0x110000, 0x10000):
        points = [c for c in range(start, start + 0x10000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        points = np.array(points)
        for what, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                out[points[m.start() : m.end()]] = what
    out[WHITE_SPACE] = BLANK
    out[32] = SPACE
    return out


def _step(state: int, sym: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token begins at the symbol."""
    if sym == SYM_L:
        return {ONE: FRESH, TWO: ONE}.get(state, IN_L), state not in (IN_L, LEAD, ONE, TWO)
    if sym == SYM_N:
        return IN_N, state not in (IN_N, LEAD)
    if sym in (SYM_O, SYM_SHORT, SYM_LONG):
        if sym == SYM_O or state in (IN_O, LEAD):
            return IN_O, state not in (IN_O, LEAD)
        return (ONE if sym == SYM_SHORT else TWO), True
    if sym == SYM_BLANKS:
        return IN_BLANKS, state != IN_BLANKS
    return (LEAD if sym == SYM_LAST_SPACE else FRESH), True


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the transition functions: element of each symbol (8 more for a text's first), product table,
    value of each element at each state, and whether a pre-token begins by state and symbol."""
    plain = [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    first = [(f[FRESH],) * 8 for f in plain]
    number = {tuple(range(8)): 0}
    for f in plain + first:
        number.setdefault(f, len(number))
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in plain + first:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    elements = list(number)
    product = np.array([[number[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
    begins = np.array([[_step(q, s)[1] for s in range(16) if s < 8] for q in range(8)])
    return np.array([number[f] for f in plain + first], np.uint16), product, np.array(elements, np.uint8), begins


def states_before(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """State of the automaton before each element, by an associative scan in blocks of `width`."""
    _, product, value, _ = monoid()
    n, m = len(elements), len(product)
    flat_product = product.ravel()
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for k in range(1, width):  # prefix products inside all blocks at once
        grid[k] = flat_product[grid[k - 1].astype(np.intp) * m + grid[k]]
    totals = grid[-1]
    start = states_before(totals) if rows > 1 else np.zeros(1, np.uint8)
    out = np.empty((width, rows), np.uint8)
    out[0] = start
    out[1:] = value[grid[:-1], start[None, :]]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as a mask over code points; first: index of each non-empty text's first one."""
    element, _, _, begins = monoid()
    cls = class_table()[points]
    n = len(points)
    ends = np.zeros(n, bool)
    ends[first[1:] - 1] = ends[-1] = True
    blank = cls >= SPACE
    goes_on = np.empty(n, bool)
    goes_on[:-1] = blank[1:]
    goes_on[-1] = True
    goes_on |= ends
    sym = np.where(blank, np.where(goes_on, SYM_BLANKS, np.where(cls == SPACE, SYM_LAST_SPACE, SYM_LAST_BLANK)), cls).astype(np.uint8)
    quotes = np.flatnonzero((points == 39) & ~ends)
    if len(quotes):
        one = points[quotes + 1]
        two = np.where(ends[quotes + 1], 0, points[np.minimum(quotes + 2, n - 1)])
        sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SYM_SHORT
        sym[quotes[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = SYM_LONG
    shown = sym.copy()
    shown[first] += 8
    before = states_before(element[shown])
    before[first] = FRESH
    return begins[before, sym]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: merge the neighbours of least rank, leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 64:
        get, none = ranks.get, 1 << 40
        edge = list(range(n + 1))
        pair = [get(piece[i : i + 2], none) for i in range(n - 1)]  # rank of each part with the next
        while pair and (least := min(pair)) < none:
            i = pair.index(least)
            del edge[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(piece[edge[i] : edge[i + 2]], none)
            if i:
                pair[i - 1] = get(piece[edge[i - 1] : edge[i + 1]], none)
        return [ranks[piece[x:y]] for x, y in zip(edge, edge[1:], strict=False)]
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is piece[i:end[i]]; end[i] is the next part
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Merged(dict):
    """Slice to its ids as little-endian 32-bit integers; merges what it lacks."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


def _merged(path: str) -> Merged:
    """This worker's cache, kept between its tasks."""
    return kept("bpe", path, lambda: Merged(read_ranks(path)))


def slice_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First byte of each pre-token of the texts of a flat piece."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(byte_of, at[:-1][at[:-1] < at[1:]])
    return byte_of[boundaries(points, first)]


def encode_texts(data: np.ndarray, at: np.ndarray, get) -> list[bytes]:
    """Ids of each text of a flat piece."""
    if not len(data):
        return [b""] * (len(at) - 1)
    buffer = data.tobytes()
    starts = slice_starts(data, at)
    cut = np.searchsorted(starts, at).tolist()
    edges = np.append(starts, len(buffer))

    def ids(a: int, b: int) -> bytes:
        own = edges[a : b + 1].tolist()
        return b"".join([get(buffer[x:y]) for x, y in zip(own, own[1:], strict=False)])

    return [b"".join([ids(k, min(k + BLOCK, b)) for k in range(a, b, BLOCK)]) for a, b in zip(cut, cut[1:], strict=False)]


def token_offsets(ids: list[bytes], lens: np.ndarray) -> list[bytes]:
    """First byte of each token in its text, as little-endian 32-bit integers like the ids."""
    n = lens[np.frombuffer(b"".join(ids), "<u4")]
    upto = np.cumsum(n)
    first = upto - n
    cut = np.cumsum([0, *(len(x) // 4 for x in ids)]).tolist()
    return [(first[a:b] - first[a]).astype("<u4").tobytes() if a < b else b"" for a, b in zip(cut, cut[1:], strict=False)]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes], list[bytes], np.ndarray]]:
    """doc_id, ids, offsets and n_bytes of the texts, in pieces of bounded size."""
    cache, lens = _merged(path), vocabulary(path)[2]
    for batch in batches:
        data, at = flat(batch.column("text"))
        for i, j in pieces(at, OUT):
            ids, offsets = [], []
            for a, b in pieces(at[i : j + 1]):
                own = at[i + a : i + b + 1]
                part = encode_texts(data[own[0] : own[-1]], own - own[0], cache.__getitem__)
                ids += part
                offsets += token_offsets(part, lens)
            yield batch.column("doc_id").slice(i, j - i), ids, offsets, np.diff(at[i : j + 1])
        del batch, data  # before the next batch is read


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and offsets (binary: little-endian 32-bit), each token's first byte in the text, and the text's n_bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, offsets, n_bytes in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([doc_id, binaries(ids), binaries(offsets), pa.array(n_bytes)], ["doc_id", "ids", "offsets", "n_bytes"])

    kind = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("ids", "binary").add("offsets", "binary").add("n_bytes", "long")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, "bpe"), kind)


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries' bytes in one array, and first byte and length of each id; kept like the cache."""
    return kept("bpe", f"{path} as arrays", lambda: _as_arrays(_merged(path).ranks))


def _as_arrays(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [b""] * (max(ranks.values()) + 1)
    for word, k in ranks.items():
        words[k] = word
    lens = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens


def decode_ids(ids: bytes, offsets: bytes, n_bytes: int, path: str) -> bytes:
    """The text's bytes: each token's put where its offset says. Tokens must leave no byte out."""
    blob, first, lens = vocabulary(path)
    k, at = np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
    n = lens[k]
    if (n.sum(), len(at)) != (n_bytes, len(k)):
        raise ValueError("ids, offsets and the text's length don't belong together")
    out = np.zeros(n_bytes, np.uint8)
    for i in range(0, len(k), BLOCK):
        own = slice(i, i + BLOCK)
        upto = np.cumsum(n[own])
        within = np.arange(upto[-1]) - np.repeat(upto - n[own], n[own])
        out[np.repeat(at[own], n[own]) + within] = blob[np.repeat(first[k[own]], n[own]) + within]
    return out.tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, offsets and the bytes they decode to."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets, n_bytes = (batch.column(c) for c in ("ids", "offsets", "n_bytes"))
            for i, j in pieces(flat(ids)[1], OUT):
                rows = zip(ids.slice(i, j - i), offsets.slice(i, j - i), n_bytes.slice(i, j - i).to_pylist(), strict=True)
                decoded = [decode_ids(x.as_buffer(), y.as_buffer(), n, path) for x, y, n in rows]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), ids.slice(i, j - i), offsets.slice(i, j - i), binaries(decoded)], ["doc_id", "ids", "offsets", "decoded"])

    kind = T.StructType().add("doc_id", encoded.schema["doc_id"].dataType).add("ids", "binary").add("offsets", "binary").add("decoded", "binary")
    return encoded.mapInArrow(tidy(run, "bpe"), kind)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes that they decode to: encode() and decode() in one pass.

    A task has one worker, not one for each of the two, and offsets don't leave it.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, offsets, n_bytes in _encoded(batches, path):
            decoded = [decode_ids(x, y, n, path) for x, y, n in zip(ids, offsets, n_bytes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, binaries(ids), binaries(decoded)], ["doc_id", "ids", "decoded"])

    kind = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("ids", "binary").add("decoded", "binary")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, "bpe"), kind)


def counted(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and of what they decode to."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Counts and digests of what encode() and decode() give."""
    return counted(decode(encoded, path))
