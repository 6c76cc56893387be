"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id.  A source's target is met by whole
copies of all its documents plus one more copy of those whose hash is below a threshold.
The threshold is found without sorting: sizes are summed by (source, hash bucket), the
bucket in which the running sum crosses the budget is refined into finer buckets, and so
on until the buckets are single hash values.  Only those histograms are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

HASH_BITS = 60
#: Bits that each refinement resolves; 60 bits take five histograms.
BITS = 12


def id_hash(key: Column) -> Column:
    """60 uniform bits of the md5 of the key's text; null hashes as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeat: float) -> DataFrame:
    """(source, source_size) -> plus target: ``share`` of all sizes split by weight, at most ``repeat`` times the source.

    Weights go to the sources in code-point order, null last, and repeat.  A source above its
    cap is held there and the excess reshared by weight, until none is above: that is one
    water level L with target = min(cap, weight * L), found from running sums in the order in
    which sources reach their caps.  One row per source passes through the windows.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    w = (
        sizes.withColumn("_i", F.row_number().over(by_name) - 1)
        .withColumn("_w", F.element_at(table, (F.pmod("_i", F.lit(n)) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(repeat)))
    )
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_i"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    w = (
        w.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
        # the first source that does not reach its cap fixes the level
        .withColumn("_free", F.col("_w") * F.col("_level") < F.col("_cap"))
        .withColumn("_l", F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), "_i", "_level"))).over(everything)["_level"])
    )
    target = F.when(F.col("_l").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_l")))
    return w.select("source", "source_size", target.alias("target"))


#: Sources up to which their cutoffs are broadcast; with more they are joined by a shuffle.
MANY_SOURCES = 100_000


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select("*", word_count(F.col(text_col)).alias("_size"), id_hash(F.col(id_col)).alias("_h"), F.col(source_col).alias("_source"))


def cutoffs(base: DataFrame, weights: Sequence[float], share: float, repeat: float) -> DataFrame:
    """(source, size, h) -> per source: _s, source_size, target, base_copies, and below: hashes under it get one more copy."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (
        cut(source_targets(sizes, weights, share, repeat))
        .withColumn("base_copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("base_copies") * F.col("source_size"))
        .withColumn("lo", F.lit(0).cast("bigint"))
        .withColumn("acc", F.lit(0).cast("bigint"))
    )
    # lo: hashes below it are taken; acc: their size; each round fixes BITS further bits of the boundary
    inside = base
    for done in range(0, HASH_BITS, BITS):
        shift = HASH_BITS - done - BITS
        if done:
            edge = plan.select(F.col("source").alias("_s"), "lo")
            inside = base.join(edge, F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright("h", shift + BITS) == F.shiftright("lo", shift + BITS)).select(base["source"], "size", "h")
        bins = inside.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("_s").orderBy("bin")
        crossed = (
            bins.join(plan.select(F.col("source").alias("_s"), "budget", "acc"), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("upto", F.col("acc") + F.sum("n").over(run))
            .where(F.col("upto") > F.col("budget"))
            .groupBy(F.col("_s").alias("_k"))
            .agg(F.min(F.struct("bin", "upto", "n")).alias("b"))
        )
        plan = cut(
            plan.join(crossed, F.col("source").eqNullSafe(F.col("_k")), "left")
            .withColumn("acc", F.when(F.col("b").isNull(), F.col("acc")).otherwise(F.col("b.upto") - F.col("b.n")))
            # without a crossing every hash of the range is below the threshold
            .withColumn("lo", F.when(F.col("b").isNull(), F.lit((1 << HASH_BITS) - 1) if not done else F.col("lo")).otherwise(F.shiftleft("b.bin", shift)))
            .withColumn("edge", F.when(F.col("b").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("b.n")))
            .drop("_k", "b")
        )
    # `lo` is now the boundary hash itself
    take_edge = (F.col("edge") > 0) & (F.col("acc") + F.col("edge") - F.col("budget") < F.col("budget") - F.col("acc"))
    below = F.when(take_edge | ((F.col("edge") == 0) & (F.col("budget") > 0)), F.col("lo") + 1).otherwise(F.col("lo"))
    return cut(plan.select(F.col("source").alias("_s"), "source_size", "target", "base_copies", F.when(F.col("budget") > 0, below).otherwise(F.lit(0).cast("bigint")).alias("below")))


def _copies(keyed: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Adds source_size, target and _copies to rows with _source and _h."""
    small = cutoff.count() <= MANY_SOURCES
    joined = keyed.join(F.broadcast(cutoff) if small else cutoff, F.col("_source").eqNullSafe(F.col("_s")))
    return joined.withColumn("_copies", F.col("base_copies") + (F.col("_h") < F.col("below")).cast("bigint"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeat: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies (0 up to ``repeat``), taken = copies * size.

    A null text has size 0; a null source is a source of its own; rows with the same id share
    a hash and so are taken alike.  A source of size 0 has target 0.  An empty table gives no
    rows.  Other columns of ``docs`` are not read and so may have any name.  The document at
    the threshold is taken if that brings the source nearer to its target, so each source
    misses its target by at most half the size of one document (or of one set of equal ids).
    """
    base = cut(_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "doc_id", "source", "text").drop("text", "source"))
    cutoff = cutoffs(base.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_h").alias("h")), weights, share, repeat)
    out = _copies(base, cutoff)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_source").alias("source"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeat: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the mix takes, with all their columns, and ``copies``: how often each is taken.

    Nulls, repeated ids, ties at the threshold and empty tables are as in ``mix``.  ``copies`` is always
    the mix's own: an input column of that name is replaced, other names stay whatever they are.
    """
    base = cut(_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "doc_id", "source", "text").select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_h").alias("h")))
    row = docs.select(F.struct("*").alias("_row"), id_hash(F.col(id_col)).alias("_h"), F.col(source_col).alias("_source"))
    out = _copies(row, cutoffs(base, weights, share, repeat)).where("_copies > 0")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "copies"], F.col("_copies").alias("copies"))
