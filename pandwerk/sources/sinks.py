"""Writing model frames, predictions, metrics and features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pandwerk.operators.labels import require_unique


def write_split(df: DataFrame, path: str) -> None:
    """Train and test rows of a model frame, partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Keyed predictions; they are joined back by id, never by position."""
    df.select("bag_id", "pred_value", F.rint("pred_value").alias("pred_value_rounded"), "clean_floors", "split") \
        .write.mode("overwrite").partitionBy("split").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str, first: bool = True) -> None:
    df.write.mode("overwrite" if first else "append").parquet(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """Small result tables as CSV; the row order of the table is kept."""
    df.write.mode("overwrite").option("header", True).csv(path)


def geojson_geometry(geom: Column) -> Column:
    rings = F.transform(geom, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))


def geojson_features(df: DataFrame, geom: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row as text."""
    feature = F.struct(F.lit("Feature").alias("type"), geojson_geometry(F.col(geom)).alias("geometry"),
                       F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, geom: str, properties: list[str]) -> None:
    """Line-delimited features, written in parallel."""
    geojson_features(df, geom, properties).write.mode("overwrite").text(path)


def replace_table(df: DataFrame, table: str, key: str | None = None, location: str | None = None) -> None:
    """Stage a table, check its key there, then put it in place of the old one.

    The staged copy is complete before the old table goes, so the new content may derive from
    the table it replaces. ``location`` names a fresh folder for an external table.
    """
    spark = df.sparkSession
    staged = f"{table}_staged"
    writer = df.write.mode("overwrite")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(staged)
    if key is not None:
        require_unique(spark.table(staged), key)
    old = f"{table}_replaced"
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    exists = spark.catalog.tableExists(table)
    if exists:
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    if exists:
        spark.sql(f"DROP TABLE {old}")


def load_predictions_table(df: DataFrame, table: str, location: str | None = None) -> None:
    writer = df.select("bag_id", "pred_value", F.rint("pred_value").cast("int").alias("pred_value_rounded"),
                       "clean_floors").write.mode("overwrite")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(table)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
