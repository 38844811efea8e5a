"""Rows packed into batches of bounded text size, which the pair-finding operators pass around whole.

A batch is one row: its id, its rows' ids, the compressed text with offsets, and the other columns as one
Arrow message. Keys found in a batch are dealt to buckets, one row for each batch and bucket, so the
number of shuffled rows never exceeds the number of keys, and a key of many rows has one entry a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsense.functions.arrays import flat, lean, pieces, tidy
from logsense.session import checkpoint, ship

#: Bytes of text in a batch, about, and for each bucket.
BATCH, BUCKET = 2 << 20, 4 << 20
#: Rows in a batch at most; a row's number is its batch's shifted by ROW_BITS, and its place.
ROW_BITS = 16
NO_ID = np.iinfo(np.int64).max
BATCH_SCHEMA = "batch long, n_bytes long, ids binary, offsets binary, body binary, n_body long, rest binary"


def quoted(name: str) -> str:
    """A column's name as part of an expression."""
    return "`" + name.replace("`", "``") + "`"


def squeeze(x: np.ndarray | bytes) -> bytes:
    """Bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x).data if isinstance(x, np.ndarray) and len(x) else bytes(x), codec="zstd", asbytes=True)


def expand(x: bytes, size: int, kind=np.uint8) -> np.ndarray:
    """What squeeze() was given, of `size` bytes."""
    return np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), kind)


@dataclass
class Batch:
    """An unpacked batch; ids: NO_ID stands for null."""

    batch: int
    ids: np.ndarray
    at: np.ndarray
    data: np.ndarray
    rest: pa.RecordBatch


def pack(docs: DataFrame, body: str = "text") -> DataFrame:
    """Batches of docs, written to the checkpoint folder; body is null-safe text or binary."""
    ship(docs.sparkSession)
    other = [c for c in docs.columns if c != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = 0, []

        def row(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = flat(b.column("__body"))
            ids = b.column("__id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            sink, rest = pa.BufferOutputStream(), b.select(["__rest"])
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rest)
            values = [TaskContext.get().partitionId() << 20 | k, len(data), ids.astype("<i8").tobytes(), at.astype("<i8").tobytes(), squeeze(data), len(data), sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["batch", "n_bytes", "ids", "offsets", "body", "n_body", "rest"])

        size = n_rows = 0
        for b in batches:
            b = b.set_column(b.schema.get_field_index("__body"), "__body", b.column("__body").cast(pa.large_string()))
            at = flat(b.column("__body"))[1]
            for i, j in ((i, min(i + 1000, j)) for a, j in pieces(at, BATCH) for i in range(a, j, 1000)):
                if held and (size + at[j] - at[i] > BATCH or n_rows + j - i > 1 << ROW_BITS):
                    yield row(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    k, held, size, n_rows = k + 1, [], 0, 0
                held.append(_plain(b.slice(i, j - i)))
                size, n_rows = size + at[j] - at[i], n_rows + j - i
        if held:
            yield row(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col(quoted(body)).cast("string").alias("__body"), F.struct(*[F.col(quoted(c)) for c in other]).alias("__rest"))
    return placed(rows.mapInArrow(tidy(run), BATCH_SCHEMA), "batch")


def placed(df: DataFrame, key: str) -> DataFrame:
    """df in the checkpoint folder, dealt by a key so that later joins on it don't move it again.

    A checkpoint knows its partitioning only if it was planned without adaptive execution.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


#: Keys that hold more than such a share of all rows are looked up in a broadcast table.
HEAVY = 50_000


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined (left) with a table of one row a key, whose `weight` counts the key's rows, of `total` in all.

    Keys with more than a HEAVYth of all rows can't be more than HEAVY: they are broadcast, and no other key
    has enough rows to hold up its task.
    """
    most = max(1000, total // HEAVY)
    own = [c for c in table.columns if c not in on and c != "weight"]
    heavy = table.where(F.col("weight") > most).select(*on, *own, F.lit(True).alias("__heavy"))
    x = rows.join(F.broadcast(heavy), on, "left")
    light = x.where("__heavy is null").select(rows.columns).join(table.where(F.col("weight") <= most).select(*on, *own), on, "left")
    return x.where("__heavy").select(*rows.columns, *own).unionByName(light.select(*rows.columns, *own))


def _plain(b: pa.RecordBatch) -> pa.RecordBatch:
    """A copy without references to the larger batch it is cut from."""
    return b.take(pa.array(np.arange(len(b))))


def unpack(r: dict) -> Batch:
    """The batch in one row."""
    lean()
    data = expand(r["body"], r["n_body"]) if r["n_body"] else np.zeros(0, np.uint8)
    with pa.ipc.open_stream(r["rest"]) as s:
        rest = s.read_all().combine_chunks().to_batches()[0]
    return Batch(r["batch"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["offsets"], "<i8"), data, rest)


def bucket_count(batches: DataFrame, size: int = BUCKET) -> int:
    """Buckets for so much text: in proportion to it."""
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    return int(max(8, total // size))


def replies(rows: DataFrame) -> DataFrame:
    """Per batch, its replies (bucket, reply) from all buckets."""
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))


def with_replies(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Batches with their replies; null if they have none."""
    return batches.join(replies(rows), "batch", "left")
