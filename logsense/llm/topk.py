"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are packed into blocks of bounded size, each with its vectors and, for every dimension, the
list of its rows sorted by value. A query goes down all lists at once, from the end that its sign makes
best, scores every row it meets in full, and stops when the scores at the current depth cannot beat its
kth result. Queries are packed too. Each searches one block first; its kth score there goes with it to all
others, where it stops sooner and returns only what may still be among its k best. The best of all blocks
are ranked per query at the end.

Defined cases: vectors that are null or hold null or non-finite components take no part; a query is only
compared with vectors of its own length; every row but the query's own is a candidate, be it a copy of the
query, of the same vec_id, or without one; a query stored several times has its results as often; ties go to
the smaller vec_id, null last; a score beyond a long's range counts as the nearest long; fewer candidates
than k give fewer results; an empty table gives no rows; other columns are ignored. Copies (equal vec_id and
vector) are counted before packing and told apart again at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsense.functions.arrays import tidy, tidy_group
from logsense.session import checkpoint, ship

CANDIDATES, QUERIES_AT_ONCE, SCALE = 8192, 1024, 64
#: Partitions at most over which blocks are dealt.
MOST_PARTS = 20_000
_LONG = np.iinfo(np.int64)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector as doubles, of the rows that take part."""
    x = vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return x.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))


def counted(vectors: DataFrame) -> DataFrame:
    """Distinct vec_id and x with the number of their rows and a key, so that copies don't take places among a block's best."""
    x = vectors.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies"))
    return x.withColumns({"key": F.xxhash64("vec_id", "x"), "dim": F.size("x")})


def exact_kind(rows: np.ndarray, others: np.ndarray) -> type:
    """A type in which inner products of these integers are exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(others).max(initial=0)) * rows.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def packed(vectors: DataFrame, size: int, n: int, lists: bool) -> DataFrame:
    """Blocks of about `size` vectors of one length: block, dim, ids, no_id, keys, copies, values and sorted lists as bytes."""
    blocks = max(1, -(-n // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.floor(SCALE * np.stack(pdf["x"].to_numpy()))
        order = np.argsort(values, axis=0, kind="stable").T.astype("<u4").tobytes() if lists else b""
        raw = {"ids": pdf["vec_id"].fillna(0).to_numpy("<i8"), "no_id": pdf["vec_id"].isna().to_numpy(bool), "keys": pdf["key"].to_numpy("<i8"), "copies": pdf["copies"].to_numpy("<i8"), "vals": values.astype("<f8")}
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "dim": pdf["dim"].iloc[:1].to_numpy(), **{k: [v.tobytes()] for k, v in raw.items()}, "lists": [order]})

    x = vectors.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    return x.groupBy("block", "dim").applyInPandas(tidy_group(pack), "block int, dim int, ids binary, no_id binary, keys binary, copies binary, vals binary, lists binary")


class Block:
    """Candidates of one block; ties: their order among equal scores; met: rows that the last search met."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray, asc: np.ndarray):
        self.rows, self.asc, self.n, self.met = rows, asc, len(ids), 0
        self.ties = np.empty(len(ids), np.int64)
        self.ties[np.lexsort((ids, no_id))] = np.arange(len(ids))
        self.in_order = np.take_along_axis(rows.T, asc, 1)

    def search(self, query: np.ndarray, own: np.ndarray, k: int, least=None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows, without the places `own` and without scores below `least`."""
        n = self.n
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        seen[own] = True
        found, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        done, depth, every = 0, max(16, 2 * k), None
        while True:
            depth = min(depth, n)
            before = seen.copy()
            seen[self.asc[up, n - depth : n - done]] = True
            seen[self.asc[down, done:depth]] = True
            if not len(up) and not len(down):
                seen[:] = True
            fresh = np.flatnonzero(seen & ~before)
            if len(fresh):
                if every is None and len(fresh) > n // 16:
                    every = self.rows @ query  # cheaper than to gather so many
                new = self.rows[fresh] @ query if every is None else every[fresh]
                if new.dtype == object:
                    new = np.array([min(max(int(v), int(_LONG.min)), int(_LONG.max)) for v in new], object)
                if least is not None:
                    fresh, new = fresh[new >= least], new[new >= least]
                found, scores = np.concatenate([found, fresh]), np.concatenate([scores, new])
                if len(scores) > k and scores.dtype != object:
                    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                    found, scores = found[near], scores[near]
                best = np.lexsort((self.ties[found], -scores))[:k]
                found, scores = found[best], scores[best]
            if depth == n or seen.all():
                break
            bound = query[up] @ self.in_order[up, n - depth] + query[down] @ self.in_order[down, depth - 1]
            if len(found) == k and bound < scores[-1] or least is not None and bound < least:
                break
            done, depth = depth, depth * 3
        self.met = int(seen.sum())
        return found, scores


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, q_key, vec_id, score, copies: what each query finds in each block that it is joined with."""

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(len(frame)):
                r = frame.slice(i, 1).to_pylist()[0]
                ids, keys, copies, q_ids, q_keys = (np.frombuffer(r[c], "<i8") for c in ("ids", "keys", "copies", "q_ids", "q_keys"))
                no_id, least = np.frombuffer(r["no_id"], bool), dict(r["least"] or ())
                rows, asked = (np.frombuffer(r[c], "<f8").reshape(m, r["dim"]) for c, m in (("vals", len(ids)), ("q_vals", len(q_ids))))
                asc = np.frombuffer(r["lists"], "<u4").reshape(r["dim"], len(ids)).astype(np.int64)
                kind = exact_kind(rows, asked)
                if kind is object:
                    rows, asked = (np.array([[int(v) for v in x] for x in m], object).reshape(m.shape) for m in (rows, asked))
                else:
                    rows, asked = rows.astype(kind), asked.astype(kind)
                block, out = Block(ids, no_id, rows, asc), []
                for q_id, q_key, q in zip(q_ids.tolist(), q_keys.tolist(), asked, strict=True):
                    own = np.flatnonzero((keys == q_key) & (ids == q_id) & ~no_id)
                    got, scores = block.search(q, own[copies[own] == 1], k, least.get(q_key))
                    out.append((np.full(len(got), q_id), np.full(len(got), q_key), ids[got], no_id[got], np.array(scores, np.int64), copies[got] - np.isin(got, own)))
                q_id, q_key, vec_id, none, score, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(q_key), pa.array(vec_id, mask=none), pa.array(score), pa.array(n)], ["query_id", "q_key", "vec_id", "score", "copies"])

    return pairs.mapInArrow(tidy(search), "query_id long, q_key long, vec_id long, score long, copies long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows. Queries: ids divisible by `every`."""
    ship(vectors.sparkSession)
    rows = checkpoint(counted(valid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, n_queries = rows.count(), queries.count()
    blocks = max(1, -(-n // CANDIDATES))
    parts = min(blocks, MOST_PARTS)
    index = checkpoint(packed(rows, CANDIDATES, n, True).repartition(parts, "block"))
    asked = packed(queries, QUERIES_AT_ONCE, n_queries, False).select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("vals").alias("q_vals"))
    asked = checkpoint(asked)
    first = F.pmod("q_block", F.lit(blocks))  # the block that a query block searches first

    def pairs(asked: DataFrame) -> DataFrame:
        dealt = asked.repartition(parts, "for_block")
        return index.repartition(parts, "block").join(dealt, (F.col("block") == F.col("for_block")) & (F.col("dim") == F.col("q_dim")))

    begun = checkpoint(_searched(pairs(asked.withColumn("for_block", first).withColumn("least", F.lit(None).cast("map<bigint,bigint>"))), k))
    # k rows of equal or greater score are known for a query: nothing below the least of them is among its best
    known = begun.groupBy("query_id", "q_key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).where(F.col("found") >= k)
    own = known.withColumn("q_block", F.pmod("q_key", F.lit(max(1, -(-n_queries // QUERIES_AT_ONCE)))).cast("int"))
    own = own.groupBy("q_block").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("q_key", "least")))).alias("least"))
    rest = asked.join(own, "q_block", "left").withColumn("for_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("for_block") != first)
    found = begun.unionByName(_searched(pairs(rest), k))
    found = found.groupBy("query_id", "q_key", "vec_id", "score").agg(F.sum("copies").alias("copies"))
    w = Window.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    best = best.withColumn("before", F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")).where(F.col("before") < k)
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    best = best.select("query_id", "q_key", F.explode(ranks.cast("array<int>")).alias("rank"), "vec_id", "score")
    several = queries.where("copies > 1").select(F.col("vec_id").alias("query_id"), F.col("key").alias("q_key"), "copies")
    times = F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)))
    return best.join(several, ["query_id", "q_key"], "left").select("query_id", "rank", "vec_id", "score", F.explode(times).alias("__copy")).drop("__copy")
