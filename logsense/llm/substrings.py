"""Removal of repeated substrings by bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts in a document of smaller id. Sorting
all suffixes of a corpus is too much to move about, so the initial buckets are those of the q-grams at
anchors: in every window the q-gram of least hash. Equal windows have equal anchors, so a window whose
anchor's bucket holds one document is unique. The bucket table is built from all batches' distinct
anchors, and what is left goes on as spans, the bytes of the adjoining windows of one anchor.

Within the buckets of more than one span, positions are refined as in a suffix array built by bucket
pointers: buckets of 8 bytes first, each then sorted on the bucket pointers at a later offset. Pointers are
written as soon as a part of the buckets is sorted, so later sorts of the same pass use them, and new buckets
are refined again until they hold one position or `length` bytes are told apart. Windows equal byte for byte
are then neighbours, and the least id among them decides.

Equal spans of a batch, compared byte for byte, travel once, with their least id, so a passage in a third of
all documents has one entry a batch. Texts of any length are taken whole, in blocks.

Defined cases: a null text is empty; texts shorter than `length` bytes keep all; a null id counts as the
largest id there is; rows with equal ids don't affect each other; equal rows get equal results; an empty table
gives no rows; other columns pass through, whatever their names; without_repeats() drops the rest of a
character of which a byte goes, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsense.functions.arrays import binaries, tidy, tidy_group
from logsense.llm.batches import Batch, bucket_count, expand, pack, quoted, squeeze, unpack, with_replies

GRAM = 24
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RNG.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = int(_MULT[6])
_INVERSE = pow(_POWER, -1, 1 << 64)
#: Bytes of spans refined at once, about.
REFINED = 1 << 20
#: Windows whose anchors are sought at once: their hashes stay in the processor's cache, and below the size
#: from which lean() has every array mapped anew.
BLOCK = 1 << 13
#: Bits of an anchor's sort key that hold its position in the block; the rest is its hash.
PLACE = np.uint64(20)
#: Parts in which a pass refines its buckets, each on the pointers that the parts before it have written.
PARTS = 4


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position."""
    h = _BYTE[data]
    for k, step in enumerate((1, 2, 4)):
        h = h[:-step] * _MULT[k] + h[step:]
    eight = h
    h = h[:-8] * _MULT[3] + h[8:]
    return mix(h[:-8] * _MULT[4] + eight[16:])


class Powers:
    """Powers of a multiplier and its inverse, for hashes of any range."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = []
            for x in (_POWER, _INVERSE):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            self.up, self.down = both
        return self.up, self.down


_powers = Powers()


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hash of the bytes in each range; starts in order. Worked out in blocks, so that memory stays small."""
    out = np.zeros(len(start), np.uint64)
    cut = np.searchsorted(start, np.arange(0, len(data) + block, block))
    for i, j in zip(cut, cut[1:], strict=False):
        if i < j:
            low, high = start[i], stop[i:j].max()
            own = data[low:high]
            up, down = _powers.get(len(own) + 1)
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_BYTE[own] * up[: len(own)], out=total[1:])
            a, b = start[i:j] - low, stop[i:j] - low
            out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return out


class Spans:
    """Anchors of a batch and the windows they stand for; found in blocks of the text, so that a long text takes no more memory at once."""

    def __init__(self, b: Batch, length: int, buckets: int, block: int = BLOCK):
        self.b, self.length, n = b, length, len(b.data)
        parts = [self._block(lo, min(lo + block, n - length + 1), buckets) for lo in range(0, n - length + 1, block)]
        parts = parts or [(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint64))]
        self.first, self.n_windows, self.keys = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = (np.searchsorted(b.at, self.first, "right") - 1).astype(np.int32)

    def _block(self, lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and key of the anchors of the windows that start in a range."""
        b, length = self.b, self.length
        windows = length - GRAM + 1
        own = gram_hashes(b.data[lo : hi - 1 + length])
        least = own >> PLACE << PLACE | np.arange(len(own), dtype=np.uint64)
        done = 1
        while done * 2 <= windows:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < windows:
            least = np.minimum(least[: len(least) - (windows - done)], least[windows - done :])
        i, j = np.searchsorted(b.at, lo, "right") - 1, np.searchsorted(b.at, hi - 1, "right")
        ends = np.repeat(b.at[i + 1 : j + 1], np.diff(np.clip(b.at[i : j + 1], lo, hi)))
        inside = np.flatnonzero(np.arange(lo, hi) + length <= ends)
        anchor = (least[inside] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else anchor
        h = mix(own[anchor[new]])
        keys = (h % np.uint64(buckets)) << np.uint64(32) | (h >> np.uint64(32))
        return lo + inside[new], np.diff(np.append(new, len(inside))).astype(np.uint8), keys

    def ids(self, at=slice(None)) -> np.ndarray:
        """Document ids of anchors."""
        return self.b.ids[self.doc[at]]

    def stop(self, at: np.ndarray) -> np.ndarray:
        """Where the last windows of anchors end."""
        return self.first[at] + self.n_windows[at] + self.length - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, each anchor's place among them, and which occur under more than one id."""
        keys, place = np.unique(self.keys, return_inverse=True)
        low, high = np.full(len(keys), NO_BOUND), np.full(len(keys), -NO_BOUND)
        ids = self.ids()
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return keys, place, low != high

    def entries(self, repeated: np.ndarray) -> dict[str, np.ndarray]:
        """Of the anchors marked: distinct spans in order of bucket, each with its least id; place: of each anchor."""
        at = np.flatnonzero(repeated)
        first, stop, ids = self.first[at], self.stop(at), self.ids(at)
        h = range_hashes(self.b.data, first, stop) if len(at) else np.zeros(0, np.uint64)
        lead, place = leads(self.b.data, first, stop, h, self.keys[at], ids)
        return {"at": at, "place": place, "lead": at[lead], "bucket": (self.keys[at[lead]] >> np.uint64(32)).astype(np.int64), "ids": ids[lead]}


NO_BOUND = np.iinfo(np.int64).max


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of equal values in sorted buckets."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for i, j in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        yield int(bucket[i]), int(i), int(j)


def gathered(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after another."""
    n = stop - start
    return data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def leads(data: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of equal ranges of one key the one of least id, in order of key, and which of those stands for each range.

    Hashes only sort: a range that differs from its first in a byte stands for itself.
    """
    order = np.lexsort((ids, h, keys))
    k, hh = keys[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (k[1:] != k[:-1]) | (hh[1:] != hh[:-1])
    own = order[new][np.cumsum(new) - 1] if len(h) else order
    size = stop - start
    same = size[order] == size[own]
    for i in range(0, len(order), 1 << 14):
        x, y = order[i : i + (1 << 14)], own[i : i + (1 << 14)]
        n = np.where(same[i : i + (1 << 14)], size[x], 0)
        unequal = gathered(data, start[x], start[x] + n) != gathered(data, start[y], start[y] + n)
        same[i : i + (1 << 14)] &= np.bincount(np.repeat(np.arange(len(x)), n)[unequal], minlength=len(x)) == 0
    new |= ~same
    place = np.empty(len(h), np.int64)
    number = np.cumsum(new) - 1
    place[order] = number
    heads = np.maximum.accumulate(np.where(new & same, np.arange(len(new)), 0))
    back = same & ~new  # copies of the range at the head of their run
    place[order[back]] = number[heads[back]]
    return order[new], place


def refine(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next `length` bytes or more, and the pointer of each: the first place of its bucket.

    Buckets of q-grams first. Those of several positions are sorted on the pointers at a later offset, in parts; what a
    part's sort has told apart is written before the next part is sorted, which so sees further than its offset. New
    buckets of several positions are refined again, at twice the offset.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    gram = np.zeros(n, np.uint64)
    for k in range(8):
        gram = gram << np.uint64(8) | padded[k : k + n]
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.append(head, n))
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(head, size)
    depth = 8
    while depth < length:
        head, size = head[size > 1], size[size > 1]
        upto = np.cumsum(size)
        if not len(head):
            break
        done, heads = 0, []
        for most in (upto[-1] * k // PARTS for k in range(1, PARTS + 1)):
            stop = int(np.searchsorted(upto, most, "right"))
            if stop == done:
                continue
            n_own = size[done:stop]
            place = np.repeat(head[done:stop] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())
            at = order[place]
            later = np.where(at + depth < n, pointer[np.minimum(at + depth, n - 1)] + 1, 0)
            key = pointer[at] << 32 | later
            sort = np.argsort(key, kind="stable")
            at, key = at[sort], key[sort]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            order[place] = at
            pointer[at] = place[new][np.cumsum(new) - 1]
            heads.append(place[new])
            done = stop
        cut = np.concatenate(heads)
        ends = np.searchsorted(cut, head[1:])  # a bucket ends where the next old one begins, or its last place is
        follow = np.append(cut[1:], 0)
        last = np.append(ends - 1, len(cut) - 1)
        follow[last] = head + size
        head, size = cut, follow - cut
        depth *= 2
    return order, pointer


def window_classes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Number of each position's class: equal where the next `length` bytes are equal, byte for byte.

    Pointers may see further than `length`; windows with equal bytes are neighbours in their order, and are compared.
    """
    _, pointer = refine(data, length)
    own = pointer[at]
    values, first, inverse = np.unique(own, return_index=True, return_inverse=True)
    lead = at[first]
    new = np.ones(len(values), bool)
    step = np.arange(length)
    for i in range(1, len(values), 1 << 15):
        x, y = lead[i - 1 : i - 1 + (1 << 15)], lead[i : i + (1 << 15)]
        new[i : i + len(y)] = (data[x[: len(y), None] + step] != data[y[:, None] + step]).any(1)
    return (np.cumsum(new) - 1)[inverse]


def refined_masks(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Bit mask of each distinct span's windows that also occur in a span of smaller id."""
    n_windows = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    span = np.repeat(np.arange(len(sizes)), n_windows)
    shift = np.arange(len(span)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    pointer = window_classes(text, base[span] + shift, length)
    least = np.full(pointer.max() + 1, NO_BOUND)
    np.minimum.at(least, pointer, ids[span])
    hit = least[pointer] < ids[span]
    return np.bincount(span[hit], 2.0 ** shift[hit], len(sizes)).astype(np.uint32)


def repeated_windows(data: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Bit mask of each span's windows that also occur under a smaller id than the span's own."""
    stop = np.cumsum(sizes)
    lead, group = leads(data, stop - sizes, stop, range_hashes(data, stop - sizes, stop), keys, ids)
    masks = np.zeros(len(lead), np.uint32)
    _, kind, n = np.unique(keys[lead], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n[kind] > 1)
    shared = shared[np.argsort(kind[shared], kind="stable")]
    upto = np.cumsum(sizes[lead[shared]])
    new_kind = np.flatnonzero(np.diff(kind[shared], append=-1))  # the last span of each bucket
    i = 0
    while i < len(shared):  # whole buckets at once, up to a bounded size
        base = upto[i] - sizes[lead[shared[i]]]
        k = np.searchsorted(upto[new_kind], base + REFINED, "right") - 1
        j = max(int(new_kind[max(k, 0)]), int(new_kind[np.searchsorted(new_kind, i)])) + 1
        own = lead[shared[i:j]]
        masks[shared[i:j]] = refined_masks(gathered(data, stop[own] - sizes[own], stop[own]), sizes[own], ids[own], length)
        i = j
    return np.where(ids > ids[lead][group], np.uint32(0xFFFFFFFF), masks[group])


def _anchor_rows(batches: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for k in range(len(f)):
                r = f.slice(k, 1).to_pylist()[0]
                keys, _, several = Spans(unpack(r), length, buckets).distinct()
                rows = [(k, keys[i:j].astype("<u4").tobytes(), np.packbits(several[i:j]).tobytes()) for k, i, j in by_bucket((keys >> np.uint64(32)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()), binaries([x[1] for x in rows]), binaries([x[2] for x in rows])], ["batch", "bucket", "keys", "several"])

    return no_rest(batches).mapInArrow(tidy(run), "batch long, bucket int, keys binary, several binary")


def _empty_message() -> bytes:
    sink = pa.BufferOutputStream()
    b = pa.RecordBatch.from_arrays([pa.array([None], pa.int32())], ["x"])
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


_NO_REST = _empty_message()


def no_rest(batches: DataFrame) -> DataFrame:
    """Batches without their other columns."""
    return batches.withColumn("rest", F.lit(_NO_REST))


def _repeated_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bits of each batch's keys that occur in another batch, or under several ids."""
    parts = [np.frombuffer(x, "<u4") for x in pdf["keys"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(pdf["several"], parts, strict=True)])
    _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    hit = (n[place] > 1) | (several > 0)
    cut = np.cumsum([0, *map(len, parts)])
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "reply": [np.packbits(hit[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]})


def _flags(spans: Spans, replies: list | None) -> np.ndarray:
    """Which anchors of a batch are repeated, from the replies of its buckets."""
    keys, place, _ = spans.distinct()
    bits = [np.unpackbits(np.frombuffer(x["reply"], np.uint8), count=j - i) for x, (_, i, j) in zip(replies or [], by_bucket((keys >> np.uint64(32)).astype(np.int64)), strict=True)]
    return np.concatenate(bits)[place] > 0 if bits else np.zeros(0, bool)


def _span_rows(batches: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for k in range(len(f)):
                r = f.slice(k, 1).to_pylist()[0]
                s = Spans(unpack(r), length, buckets)
                flags = _flags(s, r["replies"])
                e = s.entries(flags)
                rows = []
                for k, i, j in by_bucket(e["bucket"]):
                    own = e["lead"][i:j]
                    text = gathered(s.b.data, s.first[own], s.stop(own))
                    rows.append((k, s.keys[own].astype("<u4").tobytes(), (s.n_windows[own]).astype(np.uint8).tobytes(), squeeze(e["ids"][i:j].astype("<i8")), len(text), squeeze(text)))
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()), binaries([x[1] for x in rows]), binaries([x[2] for x in rows]), binaries([x[3] for x in rows]), pa.array([x[4] for x in rows], pa.int64()), binaries([x[5] for x in rows])], ["batch", "bucket", "keys", "windows", "ids", "n_text", "text"])

    return no_rest(batches).mapInArrow(tidy(run), "batch long, bucket int, keys binary, windows binary, ids binary, n_text long, text binary")


def _runs(s: Spans, own: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and stop of each maximal run of removed bytes, from the masks of anchors' windows."""
    bit, parts = np.arange(s.length - GRAM + 1), []
    for i in range(0, len(own), 1 << 15):
        at = own[i : i + (1 << 15)]
        hit = ((mask[i : i + (1 << 15), None] >> bit.astype(np.uint32)) & 1 > 0) & (bit < s.n_windows[at][:, None])
        starts, doc = (s.first[at][:, None] + bit)[hit], np.repeat(s.doc[at], hit.sum(1))
        if len(starts):
            new = np.ones(len(starts), bool)
            new[1:] = (starts[1:] > starts[:-1] + s.length) | (doc[1:] != doc[:-1])
            parts.append((doc[new], starts[new], starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + s.length))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, start, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] > stop[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)]


def _remove(batches: DataFrame, length: int, buckets: int, row: T.StructType, as_text: bool) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for k in range(len(f)):
                r = f.slice(k, 1).to_pylist()[0]
                b = unpack(r)
                s = Spans(b, length, buckets)
                e = s.entries(_flags(s, r["replies"]))
                masks = [expand(x["reply"], 4 * (j - i), np.uint32) for x, (_, i, j) in zip(r["masks"] or [], by_bucket(e["bucket"]), strict=True)]
                mask = np.concatenate(masks)[e["place"]] if masks else np.zeros(0, np.uint32)
                own = e["at"]
                mask = np.where(s.ids(own) > e["ids"][e["place"]], np.uint32(0xFFFFFFFF), mask)
                doc, start, stop = _runs(s, own, mask)
                del s, e, masks, mask, own
                n_docs, edge = len(b.ids), np.zeros(len(b.data) + 1, np.int8)
                edge[start] += 1
                edge[stop] -= 1
                kept = b.data[np.cumsum(edge[:-1], dtype=np.int8) == 0]
                removed = np.bincount(doc, stop - start, n_docs).astype(np.int64)
                at = b.at - np.concatenate([[0], np.cumsum(removed)])
                if as_text:
                    raw = kept.tobytes()
                    body = pa.array([raw[i:j].decode("utf-8", "ignore") for i, j in zip(at, at[1:], strict=False)], pa.string())
                else:
                    body = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
                yield pa.RecordBatch.from_arrays([b.rest.column("__rest"), body, pa.array(np.diff(b.at)), pa.array(removed), pa.array(np.bincount(doc, minlength=n_docs).astype(np.int64))], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = T.StructType().add("row", row).add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return batches.mapInArrow(tidy(run), kind)


def remove_repeats(docs: DataFrame, length: int = 50, bucket_bytes: int | None = None, as_text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text, others): row (all but the text), kept (as bytes, or as text without cut characters), n_bytes, n_removed, n_spans."""
    if not 32 <= length < GRAM + 32:
        raise ValueError("length must be 32 to 55")
    batches = pack(docs)
    buckets = bucket_count(batches, bucket_bytes) if bucket_bytes else bucket_count(batches)
    found = _anchor_rows(batches, length, buckets).groupBy("bucket").applyInPandas(tidy_group(_repeated_anchors), "batch long, bucket int, reply binary")
    asked = with_replies(batches, found)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, "<u4") for x in pdf["keys"]]
        sizes = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["windows"]]).astype(np.int64) + length - 1
        ids = np.concatenate([expand(x, 8 * len(k), np.int64) for x, k in zip(pdf["ids"], keys, strict=True)])
        text = np.concatenate([expand(x, n) for x, n in zip(pdf["text"], pdf["n_text"], strict=True)])
        masks = repeated_windows(text, sizes, np.concatenate(keys), ids, length)
        cut = np.cumsum([0, *map(len, keys)])
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "reply": [squeeze(masks[a:b]) for a, b in zip(cut, cut[1:], strict=False)]})

    decided = _span_rows(asked, length, buckets).groupBy("bucket").applyInPandas(tidy_group(decide), "batch long, bucket int, reply binary")
    masks = decided.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("masks"))
    row = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("r")).schema["r"].dataType
    return _remove(asked.join(masks, "batch", "left"), length, buckets, row, as_text)


def repeat_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """What remove_repeats() leaves of each document, as counts and a digest."""
    x = remove_repeats(docs.select("doc_id", "text"), length)
    return x.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with the repeated bytes gone from text; bytes of a cut character go with it."""
    x = remove_repeats(docs, length, as_text=True)
    return x.select(*[(F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c)) for c in docs.columns])
