"""Mixing sources to target weights by Pareto order sampling.

A small plan holds, for each source, its size, its target, the whole copies that every document gets for
certain, and the key of the last document drawn once more. Applying the plan is a narrow projection, so
a hot source is neither gathered nor sorted: ranks are found through a histogram of the sampling order,
and only the one bin in which a source's target falls is sorted.

Defined cases: a null text has size 0; null sources form one source, last in order; a null id draws as
its own id; equal rows get equal copies; an empty table gives an empty plan and an empty mix; other
columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logsense.llm.batches import quoted
from logsense.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the sampling order for each doubling, and in all; one bin of a source is sorted in one task.
FINE, BINS = 256, 16384
#: Sources up to which a table with a row per source is broadcast.
MANY = 50_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(16**13))


def preference(size: Column) -> Column:
    """Relative inclusion of a document in thousandths: longer texts up to twice as likely."""
    return F.lit(1000) + F.floor(F.lit(1000) * size / (size + F.lit(500))).cast("long")


def _order(doc_id: Column, size: Column, f: Column, z: Column, n: Column, seed: int) -> Column:
    """Random odds divided by inclusion odds; small is drawn first."""
    odds = F.least(F.lit(1.0), f * preference(size).cast("double") / (z.cast("double") / n.cast("double")))
    u = uniform(doc_id, seed)
    return (u / (F.lit(1.0) - u)) * ((F.lit(1.0) - odds) / odds)


def _bounded(by_source: DataFrame) -> DataFrame:
    """A checkpointed table with a row per source, broadcast if its rows, counted, are few."""
    return F.broadcast(by_source) if by_source.limit(MANY + 1).count() <= MANY else by_source


def source_targets(sized: DataFrame, weights=(5, 2, 1), share=1.5, most=2) -> DataFrame:
    """One row per source: words n, preference sum z, target, whole copies, odds and words left over.

    Targets share `share` of all words by weight; none is above `most` times its source, and what that
    frees goes to the others by weight (water filling over the sources ordered by size per weight).
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.col("size") * preference(F.col("size"))).alias("z"))
    pos = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((pos - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("pos", pos).withColumn("weight", weight.cast("long"))
    w = Window.orderBy(F.col("n") / F.col("weight"), "pos")
    total = F.lit(float(share)) * F.sum("n").over(Window.partitionBy()).cast("double")
    before = F.coalesce(F.sum(F.lit(most) * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (total - before.cast("double")) / rest.cast("double"))
    fits = F.when(F.col("level") * F.col("weight") <= F.lit(float(most)) * F.col("n"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    src = src.withColumn("target", F.coalesce(F.least(F.lit(float(most)) * F.col("n"), level * F.col("weight")), F.lit(0.0)))
    ratio = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(F.lit(0.0))
    src = src.withColumn("whole", F.floor(ratio).cast("long")).withColumn("odds", ratio - F.floor(ratio).cast("double"))
    return src.select("source", "n", "z", "target", "whole", "odds", (F.col("target") - F.col("whole") * F.col("n")).alias("left"))


def plan_mix(sized: DataFrame, weights=(5, 2, 1), share=1.5, most=2, seed=7) -> DataFrame:
    """The mix of a table (doc_id, source, size): source_targets() plus the cut-off key of each source.

    A document is drawn once more if its (order, doc_id, size) isn't above the key. The key is that of
    the last document in order whose middle word lies within the words left over.
    """
    targets = _bounded(checkpoint(source_targets(sized, weights, share, most)))
    drawn = _joined(sized, targets).where((F.col("odds") > 0) & (F.col("size") > 0))
    drawn = drawn.withColumn("q", _order(F.col("doc_id"), F.col("size"), F.col("odds"), F.col("z"), F.col("n"), seed))
    drawn = drawn.withColumn("bin", _bin(F.col("q")))
    by_bin = drawn.groupBy("source", "left", "bin").agg(F.sum("size").alias("words"), F.max(_key()).alias("key"))
    upto = Window.partitionBy("source").orderBy("bin")
    by_bin = by_bin.withColumn("upto", F.sum("words").over(upto))
    inside = by_bin.where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max("key").alias("key"))
    split = by_bin.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") < F.col("left"))).select(F.col("source").alias("s"), F.col("bin").alias("b"), (F.col("upto") - F.col("words")).alias("before"))
    near = drawn.join(_bounded(checkpoint(split)), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    cum = F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("mid", F.col("before") + cum - F.col("size") / 2.0).where(F.col("mid") <= F.col("left"))
    keys = inside.unionByName(near.groupBy("source").agg(F.max(_key()).alias("key"))).groupBy("source").agg(F.max("key").alias("key"))
    keys = keys.select(F.col("source").alias("s"), "key")
    return _bounded(checkpoint(targets.join(keys, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")))


def _bin(q: Column) -> Column:
    """A number that grows with the order: 0 for 0, then so many for each doubling, as most orders are far below 1."""
    k = F.floor((F.log2(q) + 48) * FINE) + 1
    return F.when(q > 0, F.least(F.greatest(k, F.lit(1)), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def _key() -> Column:
    return F.struct(F.col("q"), F.col("doc_id").cast("long").alias("doc_id"), F.col("size"))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's row of a plan."""
    p = plan.withColumnRenamed("source", "plan_source")
    return rows.join(p, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def apply_mix(rows: DataFrame, plan: DataFrame, seed=7) -> DataFrame:
    """Rows (doc_id, source, size, anything else in one struct `row`) with source_size, target, copies."""
    x = _joined(rows, plan).withColumn("q", F.when((F.col("odds") > 0) & (F.col("size") > 0), _order(F.col("doc_id"), F.col("size"), F.col("odds"), F.col("z"), F.col("n"), seed)))
    more = F.coalesce((F.col("q").isNotNull() & (_key() <= F.col("key"))).cast("long"), F.lit(0).cast("long"))
    return x.withColumn("copies", F.col("whole") + more).withColumn("source_size", F.col("n"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of documents."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_sizes(docs_sized: DataFrame, **how) -> DataFrame:
    """Per document what the mix takes: doc_id, size, source_size, target, taken."""
    seed = how.get("seed", 7)
    x = apply_mix(docs_sized, plan_mix(docs_sized, **how), seed)
    return x.select("doc_id", "size", "source_size", F.col("target").cast(T.DoubleType()).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, docs_sized: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it, with its own columns only.

    Documents without words carry nothing into a mix and are kept once.
    """
    seed = how.get("seed", 7)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    x = apply_mix(rows, plan_mix(docs_sized, **how), seed)
    n = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    return x.where(n > 0).select("row", F.explode(F.sequence(F.lit(1), n)).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
