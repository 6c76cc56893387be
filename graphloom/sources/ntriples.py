"""N-Triples and N-Quads as distributed text, and the partitioned graph table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r'(<[^>]*>|_:[^\s]+|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*\.\s*(?:#.*)?$"


def read(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """The triples of N-Triples files (``only``: of a folder's, nested ones included, whose names fit); lines that are neither triples, comments nor blank raise when read."""
    reader = spark.read if only is None else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", only)
    lines = reader.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    bad = F.raise_error(F.concat(F.lit("not a triple: "), "value"))
    checked = lines.select(F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(bad).alias("v"))
    return checked.select(*[F.regexp_extract("v", LINE, k).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"))]).dropDuplicates()


def write(g: DataFrame, path: str) -> None:
    g.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def append(g: DataFrame, graph_id: str, path: str) -> None:
    """Adds triples to a named graph of the table; those it has already are not written again."""
    spark = g.sparkSession
    new = g.select("s", "p", "o").dropDuplicates()
    try:
        old = load(spark, path, graph_id)
        new = new.join(old, ["s", "p", "o"], "left_anti")
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.withColumn("graph_id", F.lit(graph_id)).sortWithinPartitions("p", "s").write.mode("append").partitionBy("graph_id").parquet(path)


def load(spark: SparkSession, path: str, graph_id: str) -> DataFrame:
    """A named graph, read by partition pruning; empty if there is none of that name."""
    return spark.read.schema("s string, p string, o string, graph_id string").parquet(path).where(F.col("graph_id") == graph_id).select("s", "p", "o")


def replace(g: DataFrame, graph_id: str, path: str) -> None:
    """The named graph becomes ``g``; other graphs are not touched.  An empty ``g`` needs ``delete``."""
    out = g.select("s", "p", "o").dropDuplicates().withColumn("graph_id", F.lit(graph_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(path)


def delete(spark: SparkSession, graph_id: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/graph_id={graph_id}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def graph_ids(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("s string, p string, o string, graph_id string").parquet(path).select("graph_id").distinct().collect()
    return sorted(r[0] for r in rows)
