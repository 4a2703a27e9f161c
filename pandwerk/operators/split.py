"""Reproducible train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.quantiles import smallest_per_group
from pandwerk.functions.scalar import round_half_even

# Right-closed height classes (0,5], (5,6], (6,8], (8,10], (10,inf).
HEIGHT_EDGES = (0.0, 5.0, 6.0, 8.0, 10.0)


def height_class(h: Column) -> Column:
    out = F.when(h > HEIGHT_EDGES[-1], len(HEIGHT_EDGES))
    for i in range(len(HEIGHT_EDGES) - 1, 0, -1):
        out = out.when((h > HEIGHT_EDGES[i - 1]) & (h <= HEIGHT_EDGES[i]), i)
    return out


def stratified(df: DataFrame, test_ratio: float = 0.2, seed: int = 42, key: str = "bag_id") -> DataFrame:
    """Split within height classes by the order of a hash of the id; rows without height drop out.

    Only the hash at which the test share of each class ends is looked up, so the rows
    themselves are not shuffled.
    """
    rows = df.where(F.col("h_70p").isNotNull() & ~F.isnan("h_70p")).withColumn("h_cat", height_class(F.col("h_70p")))
    hashed = F.md5(F.concat(F.col(key), F.lit(f":{seed}")))
    # a class without a label (height of zero or less) is a stratum of its own
    stratum = rows.withColumn("_s", F.coalesce("h_cat", F.lit(0)))
    take = stratum.groupBy("_s").agg(F.count("*").alias("_n")).select(
        "_s", round_half_even(F.col("_n") * F.lit(float(test_ratio))).cast("bigint").alias("k"))
    cut = smallest_per_group(stratum, ["_s"], hashed, key, take)
    cut = cut.withColumnsRenamed({"cut_hash": "_ch", "cut_id": "_ci"})
    own = hashed
    in_test = (own < F.col("_ch")) | ((own == F.col("_ch")) & (F.col(key) <= F.col("_ci")))
    # one row per height class
    return (stratum.join(F.broadcast(cut), "_s", "left")
            .withColumn("split", F.when(F.coalesce(in_test, F.lit(False)), "test").otherwise("train"))
            .drop("_s", "_ch", "_ci", "h_cat"))


def id_hash(c: Column) -> Column:
    """CRC-32 of the id as a little-endian 64-bit integer."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.crc32(F.unhex(F.array_join(F.reverse(pairs), "")))


def by_id_hash(df: DataFrame, test_ratio: float = 0.2, key: str = "bag_id") -> DataFrame:
    """A row's side depends on its id only, so it stays put when the table grows."""
    limit = F.lit(float(test_ratio)) * F.lit(float(2**32))
    return df.withColumn("split", F.when(id_hash(F.col(key)) < limit, "test").otherwise("train"))


def train_test(df: DataFrame, features: list[str], test_ratio: float = 0.2, seed: int = 42,
               key: str = "bag_id") -> DataFrame:
    """Stratified when height is among the features, else by id."""
    if "h_70p" in features:
        return stratified(df, test_ratio, seed, key)
    return by_id_hash(df, test_ratio, key)
