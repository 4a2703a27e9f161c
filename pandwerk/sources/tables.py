"""Reading registers, model frames and hand-checked labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pandwerk.functions import geom2d
from pandwerk.operators.predicates import region_clip

MANUAL_LABELS = "bag_id string, td_floors int, is_clean string, actual_floors int"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """Columns and predicate both reach the Parquet scan."""
    df = spark.read.parquet(path)
    return select_where(df, columns, where)


def select_where(df: DataFrame, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def read_register(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
                  columns: list[str] | None = None, where: str | None = None, **options: str) -> DataFrame:
    """A live register over JDBC, read in parallel by ranges of a numeric key."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
              .option("numPartitions", partitions).options(**options))
    return select_where(reader.load(), columns, where)


def clip(df: DataFrame, region: list, geom: str = "geom", srid: int = 28992, where: str | Column | None = None) -> DataFrame:
    """Rows whose geometry, or any part of it, meets a polygon, stamped with the reference-system code."""
    kept = df if where is None else df.where(where)
    if geom2d.is_multi_part(df, geom):
        meets = F.exists(geom, lambda g: region_clip(g, region))
    else:
        meets = region_clip(F.col(geom), region)
    return kept.where(meets).withColumn("srid", F.lit(srid))


def collect_sources(tables: dict[str, DataFrame], columns: list[str], where: str = "is_clean IS NOT NULL") -> DataFrame:
    """The same projection and predicate over several sources, stacked with their name."""
    frames = [select_where(df, None, where or None).select(*columns).withColumn("data_source", F.lit(name))
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, frames)


def of_sources(df: DataFrame, names: list[str], columns: list[str], where: str = "is_clean IS NOT NULL") -> DataFrame:
    """The same from one table partitioned by source; other partitions are not read."""
    kept = df.where(F.col("data_source").isin(*names))
    return select_where(kept, [*columns, "data_source"], where or None)


def read_manual_labels(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV of hand-checked labels; ids stay text."""
    return spark.read.schema(MANUAL_LABELS).option("header", True).csv(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)
