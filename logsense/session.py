"""Small helpers around a SparkSession: code shipping, shared checkpoints, table access."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(Path(_ROOT.name) / p.relative_to(_ROOT)))
    path = os.path.join(tempfile.mkdtemp(), f"{_ROOT.name}_code.zip")
    Path(path).write_bytes(blob.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through the shared checkpoint folder.

    The folder is the session's spark.checkpoint.dir; where it names none, a local session takes a
    temporary one, as in tests, and a cluster is an error.
    """
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def _shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, for a table that is written and read again."""
    return f"{_shared_dir(spark)}/table-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test-data layout: one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task works on, where work costs more than moving the rows.
SHARE = 4 << 20


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows dealt out anew: to tasks in number as its files are large, at least one for each core.

    A scan can't divide a row group, and has as many tasks as there are cores, or splits of 128 MB: its longest
    task grows with the table. Tables of as many files as tasks are scanned as they are.
    """
    df = table(spark, sf_dir, name)
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet").agg(F.count("path").alias("n"), F.sum("length").alias("size")).first()
    n = max(spark.sparkContext.defaultParallelism, -(-(files["size"] or 0) // SHARE))
    return df if files["n"] >= n else df.repartition(n)
