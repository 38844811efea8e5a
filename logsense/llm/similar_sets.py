"""Exact Jaccard join of documents' word n-gram sets, and the groups it links.

Equal sets are one class, and one row stands for each class. Sets that link share a gram in their
prefixes, the few grams that come first in an order by frequency, then hash (prefix filter). Grams of one
batch's prefixes go to buckets; those of two sets or more become index lists, sorted by size, with each
set's size, the gram's position and a parity bitmap of the set. Lists are walked with set relations:

- index level: entries are skipped in blocks, by size and position (what can still overlap), and entries
  that the set under way is already linked with, directly or not, aren't looked at;
- answer level: inside a group of candidates, the overlaps of a set are derived from those of a similar set
  whose overlaps are known, by looking up only the grams in which both differ.

A gram in the prefixes of more sets than one list may hold has no list: it is a node of the candidate graph,
linked by each batch with its sets, so no task ever holds all of them. That only adds candidates.

Candidate links are kept as stars, never as all pairs; their components are found with large and small
stars in Spark. A component's sets are compared exactly in groups of bounded size. A larger component is
compared with its first set, whole; what doesn't link goes, as a query set in blocks, against all of it.

Defined cases: a null or empty text has an empty set and is linked with nothing; with fewer words than n,
the words are one gram; null ids are never a component's id unless all are null; rows with equal ids are
different rows; equal rows have equal sets; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsense.functions.arrays import binaries, tidy, tidy_group
from logsense.llm.batches import NO_ID, ROW_BITS, Batch, bucket_count, expand, looked_up, pack, quoted, squeeze, unpack
from logsense.llm.substrings import _MULT, NO_BOUND, by_bucket, gathered, mix, no_rest, range_hashes
from logsense.session import checkpoint

#: Frequent grams that the order knows, at most; the order needs no more to be right.
FREQUENT = 200_000
#: Sets in a batch that share a gram before it is reported as frequent.
OFTEN = 4
#: Bits of the smallest bitmap, as a binary logarithm.
LEAST_LEVEL = 9
#: Grams of all sets compared in one group.
GROUP = 1 << 20
#: Sets at most in one gram's index list; a gram of more is a node of the candidate graph instead.
HOT = 1 << 14
#: Nodes from here on are grams; rows are less.
HOT_NODE = 1 << 62
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Rule:
    """n words a gram; sets link when den * intersection >= num * union."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Grams of the prefix of sets of n grams."""
        return np.where(n > 0, n - -(-self.num * n // self.den) + 1, 0)

    def links(self, both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether sets of n and m grams with so many in common link."""
        return self.den * both >= self.num * (n + m - both)


def part_of(b: Batch, docs: np.ndarray) -> Batch:
    """Only the chosen documents of a batch, in order."""
    if len(docs) == len(b.ids):
        return b
    at = np.append(0, np.cumsum(b.at[docs + 1] - b.at[docs]))
    data = [b.data[i:j] for i, j in zip(b.at[docs].tolist(), b.at[docs + 1].tolist(), strict=True)]
    return Batch(b.batch, b.ids[docs], at, np.concatenate([b.data[:0], *data]), None)


def gram_sets(b: Batch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sets one after another, each sorted, and where each begins."""
    data = _LOWER[b.data]
    n_docs = len(b.ids)
    solid = ~_BLANK[data]
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    heads = b.at[:-1][b.at[:-1] < b.at[1:]]
    before[heads] = False
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    after[b.at[1:][b.at[:-1] < b.at[1:]] - 1] = False
    start, stop = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    h = range_hashes(data, start, stop)
    upto = np.searchsorted(start, b.at)
    n_words = np.diff(upto)
    doc = np.repeat(np.arange(n_docs), n_words)
    length = np.minimum(n_words, words)[doc]
    first = np.flatnonzero(np.arange(len(h)) - upto[doc] <= n_words[doc] - length)
    gram = np.full(len(first), 0, np.uint64)
    for k in range(words):
        at = np.minimum(first + k, len(h) - 1)
        gram += np.where(k < length[first], mix(h[at] + _MULT[k]) * _MULT[k], np.uint64(0))
    gram, owner = mix(gram), doc[first]
    order = np.argsort(gram)  # equal grams of one owner are alike
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]  # a batch has no more rows
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(n_docs + 1))


class Prefixes:
    """Prefix grams of the chosen documents of a batch, in order of document (its place among the chosen) and position."""

    def __init__(self, b: Batch, rule: Rule, chosen: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], buckets: int):
        self.chosen = chosen
        self.grams, self.at = gram_sets(part_of(b, chosen), rule.words)
        self.n = np.diff(self.at)
        owner = np.repeat(np.arange(len(chosen)), self.n)
        weight = np.zeros(len(self.grams), np.uint8)
        if len(frequent[0]) and len(self.grams):
            k = np.minimum(np.searchsorted(frequent[0], self.grams), len(frequent[0]) - 1)
            weight = np.where(frequent[0][k] == self.grams, frequent[1][k], 0).astype(np.uint8)
        order = np.argsort(owner << 8 | weight, kind="stable")  # in order of owner and gram already
        place = np.arange(len(order)) - self.at[owner]  # owners are in order already
        used = place < rule.prefix(self.n)[owner]
        self.doc, self.place, gram = owner[used], place[used], self.grams[order][used]
        h = mix(gram + np.uint64(77))
        self.keys = (h % np.uint64(buckets)) << np.uint64(32) | (h >> np.uint64(32))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, each gram's place among them, and in how many sets each is."""
        return np.unique(self.keys, return_inverse=True, return_counts=True)


def levels(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the bits in a set's bitmap: no fewer than its grams."""
    return np.maximum(LEAST_LEVEL, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)


def bitmaps(grams: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the documents' sets, one after another, as bytes."""
    n = at[docs + 1] - at[docs]
    bits = 1 << levels(n)
    owner = np.repeat(np.arange(len(docs)), n)
    where = np.repeat(at[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    bit = (grams[where] & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount((np.cumsum(bits) - bits)[owner] + bit, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8))


class Maps:
    """Bitmaps by level, each also folded to the level below, so that near sizes can be compared."""

    def __init__(self, words: np.ndarray, n: np.ndarray, docs: np.ndarray):
        size = (1 << levels(n)) >> 6
        first = (np.cumsum(size) - size)[docs]
        self.level = levels(n[docs])
        self.table, self.place = {}, {}
        for level in np.unique(self.level)[::-1].tolist():
            own = np.flatnonzero(self.level == level)
            rows = words[first[own][:, None] + np.arange(1 << level >> 6)]
            self._add(level, own, rows)
            if level > LEAST_LEVEL:
                self._add(level - 1, own, rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :])

    def _add(self, level: int, docs: np.ndarray, rows: np.ndarray) -> None:
        place = self.place.setdefault(level, np.full(len(self.level), -1))
        old = self.table.get(level)
        place[docs] = np.arange(len(docs)) + (0 if old is None else len(old))
        self.table[level] = rows if old is None else np.concatenate([old, rows])

    def unlike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of sets x and y differ; 0 where their sizes are too far apart."""
        out = np.zeros(len(x), np.int64)
        low, high = np.minimum(self.level[x], self.level[y]), np.maximum(self.level[x], self.level[y])
        for level in np.unique(low).tolist():
            own = np.flatnonzero((low == level) & (high <= level + 1))
            for k in range(0, len(own), 4096):
                part, place = own[k : k + 4096], self.place[level]
                out[part] = np.bitwise_count(self.table[level][place[x[part]]] ^ self.table[level][place[y[part]]]).sum(-1)
        return out


class Union:
    """Union-find over numbers below n."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        """Root of each number; all numbers point to theirs afterwards."""
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return self.up
            self.up = up


def candidate_links(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, maps: Maps, rule: Rule) -> np.ndarray:
    """Root of each set under the links that size, position and bitmap leave possible in the lists of a bucket.

    All lists are walked at once: each entry with the one that follows it, then with the second one, and so on.
    """
    order = np.lexsort((place, n[doc], keys))
    keys, doc, place = keys[order], doc[order], place[order]
    size, found, at = n[doc], Union(len(n)), np.arange(len(keys))
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else at
    of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(keys))))

    # Lists are in order of size, so the rest of one is skipped as a block: no longer set can link with an entry's
    # set, which has no more in common with it than its grams from the entry's position on.
    left = size - place
    longest = np.minimum(size * rule.den // rule.num, (rule.num + rule.den) * left // rule.num - size)
    reach = np.searchsorted(of << 32 | size, of << 32 | np.maximum(longest, 0), "right") - 1 - at
    active = np.flatnonzero(reach > 0)
    active = active[np.argsort(-reach[active], kind="stable")]
    n_active = np.searchsorted(-reach[active], -np.arange(1, reach.max(initial=0) + 1), "right")

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether entries x and y may link."""
        a, b = size[x], size[y]
        most = np.minimum(np.minimum(left[x], left[y]), np.minimum(a, b))
        may = np.flatnonzero(rule.links(most, a, b))
        a, b = a[may], b[may]
        unlike = maps.unlike(doc[x[may]], doc[y[may]])
        out = np.zeros(len(x), bool)
        out[may] = rule.links(np.minimum(most[may], (a + b - unlike) // 2), a, b)
        return out

    root = found.roots()[doc]
    for step, count in enumerate(n_active.tolist(), 1):
        x = active[:count]
        x = x[root[x] != root[x + step]]
        x = x[possible(x, x + step)]
        if len(x):
            for pair in np.unique(root[x] * len(n) + root[x + step]).tolist():
                found.join(*divmod(pair, len(n)))
            root = found.roots()[doc]
    return found.roots()


def exact_links(grams: np.ndarray, at: np.ndarray, rule: Rule) -> np.ndarray:
    """Root of each set under the exact links of one group.

    An index holds each gram's owners. A set's overlaps with all others come from the index, or, if a linked
    set's overlaps are at hand, from those and the grams that only one of both has.
    """
    n, m = np.diff(at), len(at) - 1
    if m == 2:
        both = len(np.intersect1d(grams[at[0] : at[1]], grams[at[1] : at[2]], assume_unique=True))
        return np.array([0, 0 if rule.links(both, n[0], n[1]) else 1])
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(grams, kind="stable")
    index, owner = grams[order], owner[order]

    def overlaps(x: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(index, x, "left"), np.searchsorted(index, x, "right")
        k = hi - lo
        return np.bincount(owner[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=m)

    found, known = Union(m), {}
    for u in np.argsort(n, kind="stable").tolist():
        roots = found.roots()
        near = (n * rule.den >= n[u] * rule.num) & (n[u] * rule.den >= n * rule.num)
        if not (near & (roots != roots[u])).any():
            continue
        own = grams[at[u] : at[u + 1]]
        if (root := int(roots[u])) in known:
            base, counts = known[root]
            counts = counts + overlaps(np.setdiff1d(own, base, assume_unique=True)) - overlaps(np.setdiff1d(base, own, assume_unique=True))
        else:
            counts = overlaps(own)
        for y in np.unique(roots[np.flatnonzero(rule.links(counts, n[u], n))]):
            found.join(u, int(y))
        known[found.find(u)] = own, counts
    return found.roots()


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, root of an edge list (u, v), u > v: the least node reachable, by large and small stars.

    A hub may have a third of all edges, so nodes find the least neighbour through looked_up().
    """
    edges = checkpoint(edges.select("u", "v").distinct())
    facts = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    size = edges.agg(*facts).first()
    for _ in range(rounds if size[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("weight")))
        large = looked_up(both.where("v > u"), least, ["u"], 2 * size[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.where("u <> v").distinct())
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("weight")))
        small = looked_up(large, low, ["u"], size[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
        now = edges.agg(*facts).first()
        if now == size:
            break
        size = now
    else:
        if size[0]:
            raise RuntimeError("components haven't settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _each(batches: DataFrame, f: Callable[[dict, Batch], list[tuple]], schema: str, rest: bool = False) -> DataFrame:
    """Rows that f gives for each batch."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(len(frame)):
                r = frame.slice(i, 1).to_pylist()[0]
                rows = f(r, unpack(r))
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return (batches if rest else no_rest(batches)).mapInArrow(tidy(run), schema)


def describe(batches: DataFrame, rule: Rule) -> DataFrame:
    """Per batch, as bytes: ids, set sizes, two sums that tell sets apart, and the grams that many sets share."""

    def one(r: dict, b: Batch) -> list[tuple]:
        grams, at = gram_sets(b, rule.words)
        total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(grams + _MULT[k]))]) for k in (4, 5)]
        a, c = (np.ascontiguousarray(t[at[1:]] - t[at[:-1]]).astype("<u8").tobytes() for t in total)
        value, count = np.unique(grams, return_counts=True)
        many = count >= OFTEN
        return [(r["batch"], r["ids"], np.diff(at).astype("<i8").tobytes(), a, c, value[many].astype("<u8").tobytes(), count[many].astype("<i8").tobytes())]

    return _each(batches, one, "batch long, ids binary, n binary, a binary, c binary, often binary, counts binary")


def _rows(described: DataFrame, names: list[str], out: str, numbered: bool) -> DataFrame:
    """Columns held as bytes, as rows of longs."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(len(frame)):
                columns = [np.frombuffer(frame.column(x)[i].as_py(), "<i8") for x in names]
                if numbered:
                    columns = [(frame.column("batch")[i].as_py() << ROW_BITS) + np.arange(len(columns[0])), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], out.split())

    return described.select("batch", *names).mapInArrow(tidy(run), ", ".join(f"{x} long" for x in out.split()))


def _per_batch(rows: DataFrame, *extra: str) -> DataFrame:
    """Per batch, the numbers of its rows (and further columns) as one list."""
    at = F.struct(F.col("row").bitwiseAND((1 << ROW_BITS) - 1).alias("k"), *extra)
    return rows.groupBy(F.shiftright("row", ROW_BITS).alias("batch")).agg(F.array_sort(F.collect_list(at)).alias("chosen"))


def _repeated_grams(pdf: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Bits of each batch's keys in two sets or more of all batches, then bits of those in more than `hot`."""
    parts = [np.frombuffer(x, "<u4") for x in pdf["keys"]]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["counts"]])
    _, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, counts)[place]
    cut = np.cumsum([0, *map(len, parts)])
    reply = [b"".join(np.packbits(total[a:b] > least).tobytes() for least in (1, hot)) for a, b in zip(cut, cut[1:], strict=False)]
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "reply": reply})


def _hot_links(flags: np.ndarray, p: Prefixes, first_row: int, batch: int, wide: int) -> list[tuple]:
    """A row without sets, whose body is the links of a batch's sets with the nodes that stand for their hot grams."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    nodes, place = np.unique(np.concatenate([first_row + p.chosen[p.doc[at]], HOT_NODE + p.keys[at].astype(np.int64)]), return_inverse=True)
    found = Union(len(nodes))
    for x, y in zip(place[: len(at)].tolist(), place[len(at) :].tolist(), strict=True):
        found.join(x, y)
    links = _star(nodes, found.roots()).to_numpy("<i8")
    return [(batch % wide, len(links), 0, links.nbytes, squeeze(links))]


def _postings(flags: np.ndarray, p: Prefixes, first_row: int, wide: int) -> list[tuple]:
    """One row for each wide bucket: its repeated grams with place and set, and the sets' rows, sizes and bitmaps."""
    at = np.flatnonzero(flags)
    group = (p.keys[at] >> np.uint64(32)).astype(np.int64) % wide
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    every = np.unique(p.doc[at])
    maps = bitmaps(p.grams, p.at, every).view(np.uint64)  # once a set, though it goes to several buckets
    size = (1 << levels(p.n[every])) >> 6
    stop = np.cumsum(size)
    out = []
    for k, i, j in by_bucket(group):
        own = at[i:j]
        docs, doc = np.unique(p.doc[own], return_inverse=True)
        m = np.searchsorted(every, docs)
        parts = [p.keys[own].astype("<u8"), doc.astype("<u4"), p.place[own].astype("<u4"), (first_row + p.chosen[docs]).astype("<i8"), p.n[docs].astype("<i8"), gathered(maps, stop[m] - size[m], stop[m])]
        raw = b"".join(x.tobytes() for x in parts)
        out.append((k, len(own), len(docs), len(raw), squeeze(raw)))
    return out


def _read_postings(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Keys, sets and places of all entries, and rows, sizes and bitmaps of all sets."""
    parts, base = [], 0
    for g, m, size, x in zip(pdf["n_grams"], pdf["n_sets"], pdf["n_body"], pdf["body"], strict=True):
        raw = expand(x, size).tobytes()
        cut = np.cumsum([0, 8 * g, 4 * g, 4 * g, 8 * m, 8 * m])
        view = lambda k, kind: np.frombuffer(raw[cut[k] : cut[k + 1]], kind)  # noqa: B023, E731
        parts.append((view(0, "<u8"), view(1, "<u4").astype(np.int64) + base, view(2, "<u4").astype(np.int64), view(3, "<i8"), view(4, "<i8"), np.frombuffer(raw[cut[5] :], np.uint64)))
        base += m
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _star(rows: np.ndarray, roots: np.ndarray) -> pd.DataFrame:
    """Links of each row with the least row of its group."""
    least = np.full(len(rows), NO_BOUND)
    np.minimum.at(least, roots, rows)
    own = least[roots]
    keep = rows != own
    return pd.DataFrame({"u": rows[keep], "v": own[keep]})


def _sets_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x, "<u8") for x in pdf["grams"]]
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _verified(small: DataFrame, big: DataFrame, total: int, rule: Rule, group: int) -> DataFrame:
    """Exact links (u, v) as stars inside each candidate component, of sets (comp, weight, row, n, grams).

    small: of components of up to `group` grams; big: of the others.
    """
    parts = int(max(8, total // group))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})]
        for _, own in pdf.groupby("comp"):
            own = own.sort_values("row")
            grams, at = _sets_of(own)
            out.append(_star(own["row"].to_numpy(), exact_links(grams, at, rule)))
        return pd.concat(out)

    small = small.withColumn("part", F.pmod(F.xxhash64("comp"), F.lit(parts)).cast("int")).select("part", "comp", "row", "grams")
    links = small.groupBy("part").applyInPandas(tidy_group(within), "u long, v long")

    # Components beyond one group: all against the component's first set, then the rest as queries in blocks.
    def blocks(grams: str):
        return F.greatest(F.lit(1), F.floor(F.col(grams) / F.lit(group))).cast("long")

    first = big.where(F.col("row") == F.col("comp")).select("comp", F.col("grams").alias("lead"), F.explode(F.sequence(F.lit(0).cast("long"), blocks("weight") - 1)).alias("salt"))
    salted = big.withColumn("salt", F.pmod(F.xxhash64("row"), blocks("weight")))

    def against_first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hit = []
            for x, y in zip(pdf["grams"], pdf["lead"], strict=True):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                hit.append(bool(rule.links(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield pdf[["comp", "row", "n", "weight", "grams"]].assign(linked=hit)

    seen = checkpoint(salted.join(first, ["comp", "salt"]).mapInPandas(tidy(against_first), "comp long, row long, n long, weight long, grams binary, linked boolean"))
    links = links.unionByName(seen.where("linked and row <> comp").select(F.col("row").alias("u"), F.col("comp").alias("v")))
    rest = seen.where("not linked")

    def packed(rows: DataFrame, size: str) -> DataFrame:
        """Blocks of about `group` grams of one component, whose grams are as many as the column `size` says."""
        def pack_sets(pdf: pd.DataFrame) -> pd.DataFrame:
            few = {c: pdf[c].iloc[:1].to_numpy() for c in ("comp", "block", "weight")}
            return pd.DataFrame({**few, "rows": [pdf["row"].to_numpy("<i8").tobytes()], "linked": [pdf["linked"].to_numpy(bool).tobytes()], "sizes": [pdf["n"].to_numpy("<i8").tobytes()], "all_grams": [b"".join(pdf["grams"])]})

        return rows.withColumn("block", F.pmod(F.xxhash64("row"), blocks(size))).groupBy("comp", "block").applyInPandas(tidy_group(pack_sets), "comp long, block long, weight long, rows binary, linked binary, sizes binary, all_grams binary")

    asked = packed(rest.join(rest.groupBy("comp").agg(F.sum("n").alias("own")), "comp"), "own")
    asked = asked.select("comp", F.explode(F.sequence(F.lit(0).cast("long"), blocks("weight") - 1)).alias("block"), F.col("rows").alias("q_rows"), F.col("sizes").alias("q_sizes"), F.col("all_grams").alias("q_grams"))
    pairs = packed(seen, "weight").join(asked, ["comp", "block"])

    def blocks_against(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                rows, n, grams = np.frombuffer(r.rows, "<i8"), np.frombuffer(r.sizes, "<i8"), np.frombuffer(r.all_grams, "<u8")
                # all that link with the first set are one component: the first stands for them
                node = np.where(np.frombuffer(r.linked, bool), r.comp, rows)
                owner = np.repeat(np.arange(len(rows)), n)
                order = np.argsort(grams, kind="stable")
                index, owner = grams[order], owner[order]
                q_rows, q_n, q_grams = np.frombuffer(r.q_rows, "<i8"), np.frombuffer(r.q_sizes, "<i8"), np.frombuffer(r.q_grams, "<u8")
                stop = np.cumsum(q_n)
                nodes, place = np.unique(np.concatenate([q_rows, node]), return_inverse=True)
                found = Union(len(nodes))
                for k in range(len(q_rows)):
                    x = q_grams[stop[k] - q_n[k] : stop[k]]
                    lo, hi = np.searchsorted(index, x, "left"), np.searchsorted(index, x, "right")
                    c = hi - lo
                    both = np.bincount(owner[np.repeat(lo - (np.cumsum(c) - c), c) + np.arange(c.sum())], minlength=len(rows))
                    for y in np.unique(place[len(q_rows) :][rule.links(both, q_n[k], n)]):
                        found.join(int(place[k]), int(y))
                yield _star(nodes, found.roots())

    return links.unionByName(pairs.mapInPandas(tidy(blocks_against), "u long, v long"))


def similar_sets(batches: DataFrame, words: int, num: int, den: int, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """row, doc_id, n, root (a row of the same component, the same for all its rows) of every row."""
    rule = Rule(words, num, den)
    spark = batches.sparkSession
    described = checkpoint(describe(batches, rule))
    info = _rows(described, ["ids", "n", "a", "c"], "row doc_id n a c", True)
    info = info.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    often = _rows(described, ["often", "counts"], "gram count", False).groupBy("gram").agg(F.sum("count").alias("count"))
    often = often.orderBy(F.col("count").desc(), "gram").limit(FREQUENT).toPandas()
    value, order = np.unique(often["gram"].to_numpy(np.int64).view(np.uint64), return_index=True)
    weight = np.log2(often["count"].to_numpy(np.float64)[order] + 1).astype(np.uint8)
    frequent = spark.sparkContext.broadcast((value, weight))

    classes = checkpoint(info.where("n > 0").groupBy("n", "a", "c").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("weight")))
    buckets = bucket_count(batches, 8 << 20)
    wide = max(8, buckets // 4)
    of_classes = _per_batch(classes.select(F.col("first").alias("row")))

    def prefixes(r: dict, b: Batch) -> Prefixes:
        return Prefixes(b, rule, np.array([x["k"] for x in r["chosen"] or []], np.int64), frequent.value, buckets)

    def keys(r: dict, b: Batch) -> list[tuple]:
        k, _, count = prefixes(r, b).distinct()
        count = np.minimum(count, np.iinfo(np.uint16).max).astype("<u2")
        return [(r["batch"], x, k[i:j].astype("<u4").tobytes(), count[i:j].tobytes()) for x, i, j in by_bucket((k >> np.uint64(32)).astype(np.int64))]

    chosen = batches.join(of_classes, "batch")
    repeated = _each(chosen, keys, "batch long, bucket int, keys binary, counts binary").groupBy("bucket")
    repeated = repeated.applyInPandas(tidy_group(lambda pdf: _repeated_grams(pdf, hot)), "batch long, bucket int, reply binary")
    repeated = repeated.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))

    def postings(r: dict, b: Batch) -> list[tuple]:
        p = prefixes(r, b)
        k, place, _ = p.distinct()
        if not len(k):
            return []
        bits = []
        for x, (_, i, j) in zip(r["replies"], by_bucket((k >> np.uint64(32)).astype(np.int64)), strict=True):
            both = np.frombuffer(x["reply"], np.uint8).reshape(2, -1)
            bits.append(np.unpackbits(both, axis=1, count=j - i))
        listed, often_listed = np.concatenate(bits, axis=1)[:, place] > 0
        first_row = r["batch"] << ROW_BITS
        return _postings(listed & ~often_listed, p, first_row, wide) + _hot_links(often_listed, p, first_row, r["batch"], wide)

    lists = _each(batches.join(of_classes.join(repeated, "batch"), "batch"), postings, "wide int, n_grams long, n_sets long, n_body long, body binary")

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf["n_sets"] == 0
        links = [expand(x, size, "<i8").reshape(-1, 2) for x, size in zip(pdf["body"][ready], pdf["n_body"][ready], strict=True)]
        out = [pd.DataFrame(np.concatenate(links), columns=["u", "v"])] if links else []
        if not ready.all():
            key, doc, place, row, n, words_ = _read_postings(pdf[~ready])
            rows, at = np.unique(row, return_index=True)
            out.append(_star(rows, candidate_links(key, np.searchsorted(rows, row[doc]), place, n[at], Maps(words_, n, at), rule)))
        return pd.concat(out)

    edges = lists.groupBy("wide").applyInPandas(tidy_group(candidates), "u long, v long")
    found = components(edges).where(F.col("node") < HOT_NODE)
    members = checkpoint(found.select(F.col("node").alias("row"), F.col("root").alias("comp")).unionByName(found.select(F.col("root").alias("row"), F.col("root").alias("comp")).distinct()))
    weights = members.join(classes.select(F.col("first").alias("row"), "n"), "row").groupBy("comp").agg(F.sum("n").alias("weight"))
    members = checkpoint(members.join(weights, "comp"))
    total = members.where("row = comp").agg(F.sum("weight")).first()[0] or 0

    def sets(r: dict, b: Batch) -> list[tuple]:
        grams, at = gram_sets(part_of(b, np.array([x["k"] for x in r["chosen"]], np.int64)), rule.words)
        return [(x["comp"], x["weight"], (r["batch"] << ROW_BITS) + x["k"], int(j - i), grams[i:j].astype("<u8").tobytes()) for x, i, j in zip(r["chosen"], at, at[1:], strict=False)]

    def sets_of(rows: DataFrame) -> DataFrame:
        return _each(batches.join(_per_batch(rows, "comp", "weight"), "batch"), sets, "comp long, weight long, row long, n long, grams binary")

    small, big = (sets_of(members.where(x)) for x in (F.col("weight") <= group, F.col("weight") > group))
    linked = components(_verified(small, big, total, rule, group))
    roots = classes.join(linked.withColumnRenamed("node", "first"), "first", "left").select("n", "a", "c", F.coalesce("root", "first").alias("root"), "weight")
    rows = classes.agg(F.sum("weight")).first()[0] or 0
    return looked_up(info, checkpoint(roots), ["n", "a", "c"], rows).select("row", "doc_id", "n", F.coalesce("root", "row").alias("root"))


def link_groups(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    x = checkpoint(similar_sets(pack(docs.select("doc_id", "text")), words, num, den, group, hot))
    least = checkpoint(x.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("weight")))
    return looked_up(x, least, ["root"], x.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, group: int = GROUP) -> DataFrame:
    """docs without all but the row of least doc_id of each group."""
    batches = pack(docs)
    x = similar_sets(batches, words, num, den, group)
    keep = x.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("k")).select(F.col("k.row").alias("row"))
    row = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("r")).schema["r"].dataType

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(len(frame)):
                r = frame.slice(i, 1).to_pylist()[0]
                b = unpack(r)
                at = np.array([x["k"] for x in r["chosen"]], np.int64)
                body = [b.data[b.at[k] : b.at[k + 1]].tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([b.rest.column("__rest").take(pa.array(at)), binaries(body)], ["row", "text"])

    kept = batches.join(_per_batch(keep), "batch").mapInArrow(tidy(rows), T.StructType().add("row", row).add("text", "binary"))
    return kept.select(*[(F.col("text").cast("string").alias("text") if c == "text" else F.col("row")[c].alias(c)) for c in docs.columns])
