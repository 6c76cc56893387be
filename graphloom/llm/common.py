"""Column helpers shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A word is a run of anything but space and the controls 0x09-0x0D.
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of space-separated words as a bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set a local one only where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: recovery from a lost executor rereads files instead of recomputing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows up to which a table is broadcast, by its count; of a larger one each key is dealt over SALTS tasks.
SMALL, SALTS = 300_000, 32


def lookup(rows: DataFrame, known: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the other columns of ``known``, which has a key once, where it has the row's (a null key, too).

    A key that many rows share is not one task's: ``known`` is broadcast if its count allows, and
    else the rows of a key are dealt by a hash of the column ``spread``.
    """
    small = known.count() <= SMALL
    renamed = known.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if small:
        return rows.join(F.broadcast(renamed), same, "left").drop("_key")
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    renamed = renamed.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(renamed, same & (F.col("_s") == F.col("_t")), "left").drop("_key", "_s", "_t")


def delete(df: DataFrame, path: str) -> None:
    """Remove a folder that is no longer read, wherever it lies."""
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def others(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text, in one struct, so that names never clash and the text travels once."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none"))


def with_text(docs: DataFrame, row: str, text_col: str, text: Column) -> list[Column]:
    """The columns of ``docs`` again, from the struct ``row`` and a new text."""
    return [(text if c == text_col else F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns]


#: Items whose running states are found as one block.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, step) -> Column:
    """array<int>: for each item of an array, the state before it, from 0 on; ``step(state, item)`` is the state after it.

    Appending copies an array, so the states before each block are found first, then those inside.
    """
    none = F.array().cast("array<int>")

    def noted(state, after, outs):
        return F.struct(after.alias("state"), F.array_append(outs, state).alias("outs"))

    def through(b, state):
        return F.aggregate(b, F.struct(state.alias("state"), none.alias("outs")), lambda acc, x: noted(acc["state"], step(acc["state"], x), acc["outs"]), lambda a: a["outs"])

    def blocks(a):
        last = F.size(a) - 1
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(BLOCK)), lambda i: F.when(last >= 0, F.transform(F.sequence(i, F.least(i + (BLOCK - 1), last)), lambda j: F.get(a, j))))

    def states(bs):
        begin = F.struct(F.lit(0).alias("state"), none.alias("outs"))
        before = F.aggregate(bs, begin, lambda acc, b: noted(acc["state"], F.aggregate(b, acc["state"], step), acc["outs"]), lambda a: a["outs"])
        return F.flatten(F.zip_with(bs, before, through))

    return let(F.filter(let(items, blocks), lambda b: b.isNotNull()), states)
