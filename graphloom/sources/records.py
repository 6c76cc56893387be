"""Records from files: every cell a string, with the kind of record in ``rtype``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_csv(spark: SparkSession, path: str | None = None, data: list[str] | None = None) -> DataFrame:
    """A CSV file, or its lines; exactly one of both.  rtype is the path, or "data stream"."""
    if (path is None) == (data is None):
        raise ValueError("give either a path or data")
    reader = spark.read.option("header", True).option("inferSchema", False)
    if path is not None:
        return reader.csv(path).withColumn("rtype", F.lit(path))
    return reader.csv(spark.sparkContext.parallelize(data)).withColumn("rtype", F.lit("data stream"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """(rtype, fields) from a JSON list of records; nested values stay JSON text."""
    return spark.read.schema("rtype string, fields map<string,string>").option("multiLine", True).json(path)


def to_json(records: DataFrame) -> DataFrame:
    """(value) one JSON record a row, from (rtype, fields)."""
    return records.select(F.to_json(F.struct("rtype", "fields")).alias("value"))


def as_records(table: DataFrame, rtype: str) -> DataFrame:
    """Rows of a table as (rtype, fields)."""
    cells = [x for c in table.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return table.select(F.lit(rtype).alias("rtype"), F.create_map(*cells).alias("fields"))


def columns_of(records: DataFrame, rtype: str, names: list[str]) -> DataFrame:
    """The records of one kind as columns."""
    return records.where(F.col("rtype") == rtype).select(*[F.col("fields")[n].alias(n) for n in names])


def bacnet(records: DataFrame) -> DataFrame:
    """Device and Object records of a network scan as bindings: kind, name, device, identifier."""
    f = F.col("fields")
    kind = F.when(F.col("rtype") == "Device", "device").when(F.col("rtype") == "Object", "point")
    device = F.regexp_replace(f["device_id"], " ", "_")
    point = F.concat_ws("-", F.regexp_replace(f["name"], " ", "_"), f["address"])
    return records.where(kind.isNotNull()).select(kind.alias("kind"), F.when(F.col("rtype") == "Device", device).otherwise(point).alias("name"), device.alias("device"), F.when(F.col("rtype") == "Object", F.concat_ws(",", f["type"], f["address"])).alias("identifier"))


def from_xlsx(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(rtype, fields) from every sheet of a workbook or of a folder's, the first row being the header; at most ``limit`` - 2 rows of each sheet."""
    from .files import workbooks

    return workbooks(spark, path, limit)
